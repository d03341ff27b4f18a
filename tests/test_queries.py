"""Every query with SQL agrees with DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from swaylark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def same(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or abs(a - b) <= 1e-6 * max(1, abs(a), abs(b))
    return a == b


def key(row) -> str:
    return str([f"{x:.4g}" if isinstance(x, float) else x for x in row])


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, con, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    a = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    b = sorted(con.sql(f"SELECT {quoted} FROM want").fetchall(), key=key)
    assert len(a) == len(b)
    assert all(same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


def test_spaced_points_against_a_loop(spark):
    from pyspark.sql import functions as F

    from swaylark.sources import adapters

    t = adapters.tracks(spark, SF).withColumn("r", F.round(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), 6)).toPandas()
    want = set()
    for frame, rows in t.groupby("frame"):
        kept = []
        for r in rows.sort_values(["r", "point_id"], ascending=[False, True]).itertuples():
            if all(math.hypot(r.x - a, r.y - b) >= 5 for a, b in kept):
                kept.append((r.x, r.y))
                want.add((frame, r.point_id))
    assert {tuple(r) for r in entry.queries()["spaced_points"](spark, SF).collect()} == want


@pytest.mark.parametrize("name", ["robust_affine", "robust_homography"])
def test_robust_fits_agree_with_at_least_as_many_points_as_the_plain_ones(spark, name):
    got = entry.queries()[name](spark, SF).toPandas().set_index("frame")
    assert len(got) == 500 and got.n.between(27, 28).all() and (got.n_inliers >= 4).all() and (got.fit_rmse <= 10).mean() > 0.6


def test_surrogate_null_test_has_whole_draws(spark):
    got = entry.queries()["surrogate_null_test"](spark, SF).toPandas()
    assert len(got) and got.p_value.between(1 / 1001, 1).all() and got.observed.between(0, 1).all()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
