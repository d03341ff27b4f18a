"""Set operations on ids, natural order, top rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import natural_key


def membership(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Every id of either side once, with in_a and in_b: union, intersection and difference in one pass."""
    both = a.select(column, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(column, F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy(column).agg((F.max("a") == 1).alias("in_a"), (F.max("b") == 1).alias("in_b"))


def naturally_first(df: DataFrame, column: str, n: int) -> DataFrame:
    """The first n names in natural order: whole numbers by value, then other names. A sorted limit: each task keeps n rows."""
    return df.orderBy(*natural_key(F.col(column))).limit(n)


def top_per_group(df: DataFrame, group: str, value: str, tie: str, n: int) -> DataFrame:
    """The n greatest of each group with their ranks; of equals the least ``tie``."""
    w = W.partitionBy(group).orderBy(F.col(value).desc(), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def stacked(parts: list[DataFrame]) -> DataFrame:
    """All rows of all tables; a column that a table lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def concatenated_tracks(parts: list[DataFrame]) -> DataFrame:
    """Track batches (frame, point_id, ..., reseed_id) as one, with the greatest reseed_id of all; batches of other points are an error."""
    if not parts:
        raise ValueError("at least one batch is needed")
    both = stacked([p.withColumn("_batch", F.lit(i)) for i, p in enumerate(parts)])
    if not both.groupBy("point_id").agg(F.count_distinct("_batch").alias("n")).where(F.col("n") < len(parts)).isEmpty():
        raise ValueError("batches have different points")
    most = both.agg(F.max("reseed_id").alias("reseed_id"))
    return both.drop("_batch", "reseed_id").crossJoin(F.broadcast(most))  # one row
