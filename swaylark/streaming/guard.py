"""What a stream's run leaves behind: a row for each micro-batch and observed table, events, and a manifest.

Numbers of the rows themselves are observed metrics: they are part of the micro-batch's plan, cost no pass of their own, and come with
its progress. A listener with a folder writes each row as it comes, as a small JSON file, so a run of any length is
held nowhere; without one it keeps rows until they are asked for.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

#: The tables of a run and their columns.
EVENTS = "monotonic_s double, event string, worker string, exception_type string, reason string, action string"
TIMING = "worker string, batch_id long, rows long, rows_per_second double, duration_ms string"
QUEUE = "worker string, batch_id long, name string, rows long, rejected long, first_t double, last_t double"
MANIFEST = "worker string, run_id string, started string, batches long, rows long, rejected long, status string"


def observed(df: DataFrame, name: str, t: str = "t", rejected: str | Column | None = None) -> DataFrame:
    """``df``, of which each micro-batch counts its rows, those rejected (a flag), and the first and last time."""
    flag = F.col(rejected) if isinstance(rejected, str) else rejected if rejected is not None else F.lit(False)
    time_of = F.col(t).cast("double") if t in df.columns else F.lit(None).cast("double")
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(flag.cast("long")), F.lit(0)).alias("rejected"), F.min(time_of).alias("first_t"), F.max(time_of).alias("last_t"))


class RunAudit(StreamingQueryListener):
    """A row per micro-batch (timing), per observed table of it (queue), per query that ended (manifest) and, for one that ends with an error, an event that no output is claimed for it.

    A failed query is stopped by Spark itself. ``folder`` may be on any file system that Spark writes; reasons are kept whole.
    """

    def __init__(self, spark: SparkSession | None = None, folder: str | None = None):
        if (spark is None) != (folder is None):
            raise ValueError("a folder needs a session to write with, and the other way round")
        self.spark, self.folder, self.names = spark, folder, {}
        self.events: list[tuple] = []
        self.timing: list[tuple] = []
        self.queue: list[tuple] = []
        self.manifest: list[tuple] = []
        self.totals: dict[str, list] = {}  # of queries that run: started, batches, rows, rejected

    def _keep(self, table: str, schema: str, row: tuple) -> None:
        if self.folder is None:
            getattr(self, table).append(row)
            return
        record = json.dumps(dict(zip((c.split()[0] for c in schema.split(", ")), row, strict=True)))
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/{uuid.uuid4().hex}.json")
        out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(record.encode() + b"\n"))
        out.close()

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)
        self.totals[str(event.runId)] = [str(event.timestamp), 0, 0, 0]

    def onQueryProgress(self, event) -> None:
        p = event.progress
        worker, held = p.name or str(p.id), self.totals.setdefault(str(p.runId), [str(p.timestamp), 0, 0, 0])
        self._keep("timing", TIMING, (worker, p.batchId, p.numInputRows, float(p.processedRowsPerSecond or 0.0), json.dumps(dict(p.durationMs))))
        held[1], held[2] = held[1] + 1, held[2] + p.numInputRows
        for name, row in dict(p.observedMetrics or {}).items():
            seen = row.asDict()
            held[3] += seen.get("rejected") or 0
            self._keep("queue", QUEUE, (worker, p.batchId, name, seen.get("rows"), seen.get("rejected"), seen.get("first_t"), seen.get("last_t")))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        worker = self.names.pop(str(event.id), str(event.id))
        started, batches, rows, rejected = self.totals.pop(str(event.runId), [None, 0, 0, 0])
        self._keep("manifest", MANIFEST, (worker, str(event.runId), started, batches, rows, rejected, "FAILED" if event.exception else "COMPLETED"))
        if event.exception:
            kind = getattr(event, "errorClassOnException", None) or "StreamingQueryException"
            # The names of the event and of what was done.
            self._keep("events", EVENTS, (time.monotonic(), "worker_error", worker, kind, str(event.exception), "stop_without_output_claim"))

    def _rows(self, spark: SparkSession, table: str, schema: str) -> DataFrame:
        if self.folder is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
            if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
                return spark.read.schema(schema).json(f"{self.folder}/{table}")
            return spark.createDataFrame([], schema)
        return spark.createDataFrame(list(getattr(self, table)), schema)

    def event_rows(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, "events", EVENTS)

    def timing_rows(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, "timing", TIMING)

    def queue_rows(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, "queue", QUEUE)

    def manifest_rows(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, "manifest", MANIFEST)

    def write(self, spark: SparkSession, folder: str) -> None:
        """What is kept so far, as tables below ``folder``."""
        self.event_rows(spark).write.mode("append").json(f"{folder}/events")
        for name, rows in (("timing", self.timing_rows(spark)), ("queue", self.queue_rows(spark)), ("manifest", self.manifest_rows(spark))):
            rows.write.mode("append").parquet(f"{folder}/{name}")
