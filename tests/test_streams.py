"""Streams against tables: blocks, online derivatives, and state that goes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from swaylark.operators import derivatives, timebase
from swaylark.streaming import blocks, guard, online

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def recorded(sizes, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for record, n in enumerate(sizes):
        t = np.cumsum(rng.uniform(0.5, 1.5, n))
        rows += [(record, i, float(t[i]), float(rng.normal()), i == n - 1) for i in range(n)]
    return rows


def played(spark, batches, schema, tmp_path, make, watermark=None):
    """Each list of rows is a micro-batch; what comes out, and the rows of state that are left."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    if watermark:
        stream = stream.withWatermark(watermark, "0 seconds")
    q = make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    assert q.awaitTermination(240) and q.exception() is None
    return spark.read.parquet(str(tmp_path / "out")), q.lastProgress["stateOperators"][0]["numRowsTotal"]


def cuts(rows, parts, seed):
    """The rows in their order, split at random; a part's rows in no order."""
    rng = np.random.default_rng(seed)
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    at = sorted(rng.choice(np.arange(1, len(rows)), parts - 1, replace=False).tolist())
    return [[x[i] for i in rng.permutation(len(x))] for x in (rows[a:b] for a, b in zip([0, *at], [*at, len(rows)], strict=True))]


SCHEMA = "record_id long, seq long, t double, x double, done boolean"
SIZES = [1, 5, 8, 9, 16, 23]


@pytest.mark.parametrize("width, hop, parts", [(8, 4, 1), (8, 4, 5), (8, 8, 3), (6, 1, 4)])
def test_stream_blocks_are_those_of_the_table(rocks, tmp_path, width, hop, parts):
    rows = recorded(SIZES, width + parts)
    columns = ["record_id", "i", "block", "place", "padded", "t", "x"]
    got, left = played(rocks, cuts(rows, parts, hop), SCHEMA, tmp_path, lambda s: blocks.stream_blocks(s, width, hop, ["seq", "x"], end="done", step=0.25))
    want = timebase.padded_blocks(rocks.createDataFrame(rows, SCHEMA).withColumn("i", F.col("seq")), width, hop, tail_step=0.25)

    def listed(df):
        padded_i = F.when(F.col("padded"), F.col("block") * hop + F.col("place")).otherwise(F.col("i")).alias("i")
        return sorted((r[0], r[2], r[3], r[1], r[4], round(r[5], 9), round(r[6], 9)) for r in df.select("record_id", padded_i, *columns[2:]).collect())

    assert listed(got) == listed(want) and got.where("rejected").count() == 0
    assert left == 0  # every record has ended


def test_late_samples_come_back_and_ends_start_anew(rocks, tmp_path):
    rows = [[(1, 0, 1.0, 1.0, False), (1, 1, 2.0, 2.0, False)], [(1, 2, 2.0, 9.0, False), (1, 3, float("nan"), 9.0, False), (1, 4, 3.0, 3.0, True)], [(1, 5, 0.5, 5.0, True)]]
    got, left = played(rocks, rows, SCHEMA, tmp_path, lambda s: blocks.stream_blocks(s, 4, 2, ["seq", "x"], end="done", step=0.5))
    out = [tuple(r) for r in got.orderBy("rejected", "seq", "place").select("seq", "block", "place", "padded", "rejected", "t").collect()]
    assert [r[:5] for r in out] == [(0, 0, 0, False, False), (1, 0, 1, False, False), (4, 0, 2, False, False), (4, 0, 3, True, False), (5, 0, 0, False, False), (5, 0, 1, True, False), (5, 0, 2, True, False), (5, 0, 3, True, False), (2, None, None, False, True), (3, None, None, False, True)]
    assert out[3][5] == 4.0 and [x[5] for x in out[4:8]] == [0.5, 1.0, 1.5, 2.0] and left == 0


def test_event_time_ends_records(rocks, tmp_path):
    at = lambda s: pd.Timestamp("2026-01-01", tz="UTC").to_pydatetime() + pd.Timedelta(seconds=s).to_pytimedelta()
    schema = "record_id long, seq long, t double, x double, ts timestamp"
    rows = [[(1, k, float(k), float(k), at(k)) for k in range(5)], [(2, 0, 0.0, 0.0, at(30))], [(2, 1, 1.0, 1.0, at(31))], [(3, 0, 0.0, 0.0, at(500))], [(3, 1, 1.0, 1.0, at(501))]]
    got, left = played(rocks, rows, schema, tmp_path, lambda s: blocks.stream_blocks(s, 4, 4, ["seq", "x"], event_time="ts", idle=10.0), watermark="ts")
    out = sorted((r["record_id"], r["block"], r["place"], r["padded"], r["t"]) for r in got.where("record_id < 3").collect())
    assert out == [*[(1, 0, k, False, float(k)) for k in range(4)], (1, 1, 0, False, 4.0), *[(1, 1, k, True, 4.0 + k) for k in (1, 2, 3)], (2, 0, 0, False, 0.0), (2, 0, 1, False, 1.0), (2, 0, 2, True, 2.0), (2, 0, 3, True, 3.0)]
    assert left <= 4  # of the last record alone


def test_blocks_need_an_end(spark):
    df = spark.createDataFrame([], SCHEMA)
    for bad in ({"width": 4, "hop": 5, "end": "done"}, {"width": 4, "hop": 2}):
        with pytest.raises(ValueError):
            blocks.stream_blocks(df, columns=["seq"], **bad)
    with pytest.raises(ValueError):
        blocks.stream_blocks(df, 4, 2, ["x"], end="done")


def test_online_polynomial_is_the_trailing_fit(spark, tmp_path):
    rng = np.random.default_rng(3)
    t, x = np.cumsum(rng.uniform(0.5, 1.5, 30)), rng.normal(size=30)
    df = spark.createDataFrame([(1, i, float(t[i]), float(x[i])) for i in range(30)], "record_id long, seq long, t double, x double")
    got = online.online_signal(df, low=None, method=online.POLYNOMIAL).orderBy("seq").collect()
    want = {r["seq"]: r for r in derivatives.local_polynomial(df, window=9, order=3, least=4).collect()}
    for i, r in enumerate(got):
        assert r["startup_state"] == ("READY" if i >= 3 else f"WARMUP_{i + 1}_OF_4") and r["filtered"] == x[i]
        if i < 3:
            assert r["velocity"] is None and r["acceleration"] is None
            continue
        c = np.polynomial.polynomial.polyfit(t[max(0, i - 8) : i + 1] - t[i], x[max(0, i - 8) : i + 1], 3)
        assert r["velocity"] == pytest.approx(c[1], rel=1e-6) and r["acceleration"] == pytest.approx(2 * c[2], rel=1e-6)
        assert want[i]["velocity"] == pytest.approx(c[1], rel=1e-5) and want[i]["acceleration"] == pytest.approx(2 * c[2], rel=1e-5)
    rows = [tuple(r) for r in df.collect()]
    out, _ = played(spark, [rows[:2], rows[2:11], rows[11:]], df.schema, tmp_path, lambda s: online.online_signal(s, low=None, method=online.POLYNOMIAL))
    assert [tuple(r) for r in out.orderBy("seq").collect()] == [tuple(r) for r in got]


def test_online_motion_fits_all_channels_at_once(spark):
    rng = np.random.default_rng(4)
    rows = [(1, k, float(k), *map(float, rng.normal(size=2)), rng.normal(size=(3, 2)).tolist(), "GOOD", 0) for k in range(15)]
    df = spark.createDataFrame(rows, "record_id long, seq long, t double, x double, y double, local array<array<double>>, quality string, reseed_id long")
    got = online.online_motion(df, method=online.POLYNOMIAL).orderBy("seq").collect()
    one = online.online_signal(df, method=online.POLYNOMIAL).orderBy("seq").collect()
    assert got[0]["derivative_method"] == "causal_polynomial" and got[14]["retained_history_samples"] == 9 and got[2]["startup_state"] == "WARMUP_3_OF_4"
    for a, b in zip(got[3:], one[3:], strict=True):
        assert a["common_velocity_x"] == pytest.approx(b["velocity"]) and a["common_acceleration_x"] == pytest.approx(b["acceleration"])


def test_idle_records_are_forgotten(spark, tmp_path):
    at = lambda s: pd.Timestamp("2026-01-01", tz="UTC").to_pydatetime() + pd.Timedelta(seconds=s).to_pytimedelta()
    schema = "record_id long, seq long, t double, x double, ts timestamp"
    rows = [[(k, 0, 0.0, 1.0, at(k)) for k in range(6)], [(9, 0, 0.0, 1.0, at(5000))], [(9, 1, 1.0, 1.0, at(5001))]]
    out, left = played(spark, rows, schema, tmp_path, lambda s: online.online_signal(s, event_time="ts", idle=20.0), watermark="ts")
    assert out.count() == 8 and left == 1


def test_an_audit_writes_what_it_observes_as_it_comes(spark, tmp_path):
    import time

    audit = guard.RunAudit(spark, str(tmp_path / "audit"))
    spark.streams.addListener(audit)
    try:
        rows = [[(1, 0, 1.0, 1.0), (1, 1, 2.0, 2.0)], [(1, 2, 2.0, 9.0), (1, 3, 5.0, 3.0)], [(1, 4, float("nan"), 3.0)]]
        schema = "record_id long, seq long, t double, x double"
        for k, part in enumerate(rows):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        out = guard.observed(online.online_signal(guard.observed(stream, "in")), "out", rejected="rejected")
        q = out.writeStream.queryName("signals").format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        for _ in range(200):
            if audit.manifest_rows(spark).count():
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(audit)
    seen = audit.queue_rows(spark).where("worker = 'signals'")
    assert [tuple(r) for r in seen.where("name = 'out'").orderBy("batch_id").select("rows", "rejected").collect()] == [(2, 0), (2, 1), (1, 1)]
    assert [tuple(r) for r in seen.where("name = 'in' AND batch_id < 2").orderBy("batch_id").select("first_t", "last_t").collect()] == [(1.0, 2.0), (2.0, 5.0)]
    (run,) = audit.manifest_rows(spark).collect()
    assert (run["worker"], run["batches"], run["rows"], run["rejected"], run["status"]) == ("signals", 3, 5, 2, "COMPLETED")
    assert audit.timing_rows(spark).count() == 3 and audit.event_rows(spark).count() == 0 and not audit.timing
    with pytest.raises(ValueError):
        guard.RunAudit(folder="x")


def test_a_playlist_as_stream_is_the_table_across_loops(spark, tmp_path):
    import json
    import time

    from swaylark.sources import playlist

    rng = np.random.default_rng(9)
    paths = []
    for k, n in enumerate((40, 25, 1)):
        pd.DataFrame({"seq": range(n), "t": np.cumsum(rng.uniform(0.5, 1.5, n)), "x": rng.normal(size=n)}).to_parquet(tmp_path / f"{k}.parquet")
        paths.append(str(tmp_path / f"{k}.parquet"))
    playlist.register(spark)
    schema = playlist.playlist_schema("seq long, t double, x double")
    options = {"items": json.dumps(paths), "loops": "3"}
    table = spark.read.format("playlist").schema(schema).options(**options).load()
    assert table.count() == 3 * 66 and table.where("boundary").count() == 9 and table.select("record_id").distinct().count() == 9
    assert table.groupBy("record_id").agg(F.max("place").alias("m"), F.count(F.lit(1)).alias("n")).where("m + 1 <> n").count() == 0
    want = online.online_signal(table).orderBy("record_id", "seq").collect()
    stream = spark.readStream.format("playlist").schema(schema).options(**options, start=str(time.time() + 1), rate="60").load()
    q = online.online_signal(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(processingTime="1 second").start()
    try:
        for _ in range(120):
            if q.exception() or sum(p["numInputRows"] for p in q.recentProgress) >= 3 * 66:
                break
            time.sleep(0.5)
        q.processAllAvailable()
        assert sum(p["numInputRows"] > 0 for p in q.recentProgress) > 1  # several micro-batches, cut anywhere
    finally:
        q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("record_id", "seq").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and sum(r["samples_seen"] == 1 for r in got) == 9  # every boundary begins anew
    with pytest.raises(Exception, match="playlist has items"):
        spark.read.format("playlist").schema(schema).options(items="[]").load().count()
