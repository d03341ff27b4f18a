"""Summaries and verdicts of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import finite, ratio


def summarize(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """A row per column (and ``keys``): metric, n, mean, p50, p95, p99, max over its finite values; columns without any are left out."""
    keys = keys or []
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), finite(F.col(c)).alias("v")) for c in columns])).alias("p")).select(*keys, "p.*").where("v IS NOT NULL")
    q = F.percentile("v", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = long.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), q.alias("q"), F.max("v").alias("max"))
    return out.select(*keys, "metric", "n", "mean", *[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))], "max")


def rollup(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and greatest value at every level of ``keys`` up to the whole; level tells how many keys are summed over."""
    level = F.lit(0)
    for k in keys:
        level = level + F.grouping(k).cast("int")
    return df.rollup(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), level.alias("level"))


def counts(df: DataFrame, column: str) -> DataFrame:
    """Rows by value; missing ones are UNKNOWN."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("UNKNOWN")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def slope(df: DataFrame, value: str, keys: list[str], by: list[str]) -> DataFrame:
    """Least-squares slope of the value over its place; null for fewer than two rows."""
    placed = df.withColumn("_p", (F.row_number().over(W.partitionBy(*keys).orderBy(*by)) - 1).cast("double"))
    return placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), ratio(F.covar_pop("_p", value), F.var_pop("_p")).alias("slope"))


def upper_median(column: str) -> Column:
    """The middle value, of two the greater."""
    s = F.array_sort(F.collect_list(column))
    return F.element_at(s, F.floor(F.size(s) / 2).cast("int") + 1)


def acceptance(df: DataFrame, key: str, least_seconds: float, most_p95: float) -> DataFrame:
    """Per run (t, latency, dropped, failed): PASS, FAIL or NOT_TESTED. Runs too short were not tested."""
    g = df.groupBy(key).agg((F.max("t") - F.min("t")).alias("seconds"), F.sum("dropped").alias("dropped"), F.sum("failed").alias("failed"), F.percentile("latency", F.lit(0.95)).alias("p95"))
    bad = (F.col("dropped") > 0) | (F.col("failed") > 0) | (F.col("p95") >= most_p95)
    return g.withColumn("verdict", F.when(F.col("seconds") < least_seconds, "NOT_TESTED").when(bad, "FAIL").otherwise("PASS"))


def drop_status(df: DataFrame, key: str) -> DataFrame:
    """Per run: NO_DROPS, DROPS_COUNTED or NOT_MEASURED where nothing was counted."""
    g = df.groupBy(key).agg(F.count("dropped").alias("measured"), F.sum("dropped").alias("dropped"))
    return g.withColumn("status", F.when(F.col("measured") == 0, "NOT_MEASURED").when(F.col("dropped") > 0, "DROPS_COUNTED").otherwise("NO_DROPS"))


def bounded_queue(df: DataFrame, capacity: int, service: float, key: str = "record_id") -> DataFrame:
    """What a queue of bounded length would have rejected: arrivals t per record, each served for ``service`` in turn: accepted, rejected, deepest.

    Whether an arrival is taken depends on all before, so each record's arrivals are folded in order.
    """
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", "seq"))).alias("rows"))
    start = F.struct(F.lit(0.0).alias("free"), F.lit(0).alias("accepted"), F.lit(0).alias("rejected"), F.lit(0).alias("deepest"))

    def step(h: Column, r: Column) -> Column:
        waiting = F.ceil(F.greatest(h["free"] - r["t"], F.lit(0.0)) / service).cast("int")
        ok = waiting < capacity
        free = F.greatest(h["free"], r["t"]) + service
        return F.struct(F.when(ok, free).otherwise(h["free"]).alias("free"), (h["accepted"] + ok.cast("int")).alias("accepted"), (h["rejected"] + (~ok).cast("int")).alias("rejected"), F.greatest(h["deepest"], F.when(ok, waiting + 1).otherwise(waiting)).alias("deepest"))

    return rows.select(key, F.aggregate("rows", start, step).alias("h")).select(key, "h.accepted", "h.rejected", "h.deepest")


def latencies(df: DataFrame) -> DataFrame:
    """Adds, in milliseconds, what lies between a block's times (seconds): of capture, enqueue, tracker_start, tracker_end, motion_end, signal_end, pga_end, write_end."""
    ms = lambda a, b: (F.col(b) - F.col(a)) * 1000
    # The names of the parts.
    return df.withColumns({
        "capture_to_tracker_end": ms("capture", "tracker_end"), "capture_to_pga": ms("capture", "pga_end"), "queue_wait": ms("enqueue", "tracker_start"), "tracker_compute": ms("tracker_start", "tracker_end"),
        "postprocess_compute": ms("tracker_end", "write_end"), "motion_fit_ms": ms("tracker_end", "motion_end"), "signal_ms": ms("motion_end", "signal_end"), "pga_ms": ms("signal_end", "pga_end"),
        "total_pipeline_ms": ms("tracker_start", "write_end"), "end_to_end_latency_ms": ms("capture", "pga_end"),
    })


def reseed_status(df: DataFrame, key: str, ratio_column: str = "spike_ratio", most: float = 3.0) -> DataFrame:
    """Per run of its reseed events: events, p95 and what may be said: one harmful boundary asks for a review, one harmless one proves nothing."""
    g = df.groupBy(key).agg(F.count(ratio_column).alias("events"), F.percentile(ratio_column, F.lit(0.95)).alias("p95"))
    # The names of the states.
    state = F.when(F.col("p95").isNull(), "NOT_EVALUABLE").when(F.col("p95") > most, "FAIL_REVIEW_REQUIRED").when(F.col("events") < 2, "NOT_EVALUABLE_SINGLE_EVENT_BELOW_THRESHOLD").otherwise("PASS_P95_RATIO_LE_3")
    return g.withColumn("status", state)


def verdict_table(runs: DataFrame, *parts: tuple[str, DataFrame, str], key: str = "run") -> DataFrame:
    """Long: run, criterion, verdict. ``parts``: criterion, table, its verdict column; a run that a table lacks was NOT_MEASURED."""
    out = None
    for name, table, column in parts:
        part = runs.select(key).join(table.select(key, F.col(column).alias("verdict")), key, "left").select(key, F.lit(name).alias("criterion"), F.coalesce("verdict", F.lit("NOT_MEASURED")).alias("verdict"))
        out = part if out is None else out.unionByName(part)
    return out
