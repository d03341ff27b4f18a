"""Ranks, places and quantiles in ranges, against pandas, with ties, nulls and narrow columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from swaylark.operators import alignment, models, ranges


def frame(kind, n=600, seed=1):
    rng = np.random.default_rng(seed)
    v = {
        "spread": rng.normal(size=n) * 10.0 ** rng.integers(-3, 4, n), "ties": np.where(rng.random(n) < 0.9, 7.0, rng.integers(0, 5, n)), "epochs": 1.7e9 + rng.integers(0, 31_000_000, n),
        "equal": np.full(n, 3.0), "few": rng.integers(0, 3, n) / 2.0,
    }[kind]
    return pd.DataFrame({"k": range(n), "g": np.where(rng.random(n) < 0.6, 0, rng.integers(0, 40, n)), "v": np.asarray(v, float)})


@pytest.mark.parametrize("kind", ["spread", "ties", "epochs", "equal", "few"])
@pytest.mark.parametrize("keys", [[], ["g"]])
def test_order_against_pandas(spark, kind, keys):
    pdf = frame(kind)
    df = spark.createDataFrame(pdf).repartition(3).cache()
    order = ranges.Order(df, "v", keys, "k", count=9)
    sizes = df.groupBy(order.part()).count().toPandas()["count"]
    assert len(sizes) >= 8 and sizes.max() <= 3 * len(pdf) / 9  # no range holds much more than its share, whatever the ties
    grouped = pdf.groupby("g")["v"] if keys else pdf["v"]
    got = order.with_average_rank(df, "r").toPandas().set_index("k")["r"].sort_index()
    assert got.tolist() == grouped.rank().tolist()
    at = order.with_position(df, "p").toPandas().set_index("k")["p"].sort_index()
    place = pdf.sort_values(["v", "k"]).groupby("g").cumcount() if keys else pd.Series(range(len(pdf)), pdf.sort_values(["v", "k"]).index)
    assert at.tolist() == place.sort_index().tolist()
    want = (pdf.groupby("g")["v"] if keys else pdf.assign(g=0).groupby("g")["v"]).quantile([0.0, 0.25, 0.5, 0.95]).unstack()
    found = ranges.quantiles(df, "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95}, keys, "k").toPandas()
    if keys:
        found = found.set_index("g").sort_index()
    assert np.allclose(found[["a", "b", "c", "d"]].to_numpy(float), want.to_numpy())
    df.unpersist()


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "a", None), (3, "a", float("nan")), (4, None, 2.0), (5, "a", 4.0), (6, "b", None)], "k long, g string, v double")
    got = {r["g"]: r["m"] for r in ranges.quantiles(df, "v", {"m": 0.5}, ["g"], "k").collect()}
    assert got == {None: 1.5, "a": 4.0}
    r = {x["k"]: x["r"] for x in ranges.Order(df, "v", [], "k", count=4).with_average_rank(df, "r").collect()}
    assert (r[1], r[4], r[5], r[3]) == (3.0, 4.0, 5.0, 6.0) and r[2] == r[6] == 1.5  # null first, NaN last
    none = df.limit(0)
    assert ranges.Order(none, "v").with_position(none, "p").count() == 0 and ranges.quantiles(none, "v", {"m": 0.5}, ["g"]).count() == 0
    assert models.average_ranks(none, "v", "r").count() == 0


def test_q_values_of_many_equal_p_values(spark):
    rng = np.random.default_rng(2)
    p = np.round(np.where(rng.random(400) < 0.7, 0.05, rng.random(400)), 3)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "record_id long, p_value double")
    got = {r["record_id"]: r["q_value"] for r in alignment.bh_q_values(df).collect()}
    order = sorted(range(400), key=lambda i: (p[i], i))
    want, least = {}, 1.0
    for rank in range(400, 0, -1):
        i = order[rank - 1]
        least = min(least, p[i] * 400 / rank)
        want[i] = least
    assert got == pytest.approx(want)


def test_metrics_read_their_rows_a_few_times(spark):
    pdf = frame("few", 200)
    df = spark.createDataFrame(pdf).select("g", (F.col("v") + 1).alias("target"), (F.col("k") % 5 + 1.0).alias("predicted"))
    plan = models.metrics(df, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 8
