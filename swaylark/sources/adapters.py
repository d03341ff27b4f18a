"""The test tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each user: record_id, seq, t (seconds from the record's first), x, y, kind, i (place from 0)."""
    events = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    base = events.select(F.col("user_id").alias("record_id"), F.col("event_id").alias("seq"), us.alias("us"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), F.col("event_type").alias("kind"))
    w = W.partitionBy("record_id")
    return base.select("record_id", "seq", ((F.col("us") - F.min("us").over(w.orderBy("us", "seq").rowsBetween(W.unboundedPreceding, 0))) / F.lit(1e6)).alias("t"), "x", "y", "kind", (F.row_number().over(w.orderBy("us", "seq")) - 1).alias("i"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each frame: frame, point_id, x, y, visible."""
    frames = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "embedding")
    points = frames.select("frame", F.posexplode(F.sequence(F.lit(0), F.lit(31))).alias("point_id", "_k"), "embedding")
    at = lambda j: F.col("embedding")[2 * F.col("point_id") + j].cast("double") * 10.0
    return points.select("frame", "point_id", at(0).alias("x"), at(1).alias("y"), ((F.col("frame") + F.col("point_id")) % 7 != 0).alias("visible"))


def reference_points(track_rows: DataFrame) -> DataFrame:
    """The points of frame 0: point_id, x0, y0."""
    return track_rows.where("frame = 0").select("point_id", F.col("x").alias("x0"), F.col("y").alias("y0"))


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per order: record_id, grp (customer's nation), f1, f2, f3 (features), target (positive)."""
    orders, customer, items = (table(spark, sf_dir, x) for x in ("orders", "customer", "lineitem"))
    sums = items.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("f1"), F.count(F.lit(1)).cast("double").alias("f2"), F.max("l_discount").alias("f3"))
    rows = orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("o_orderkey").alias("record_id"), F.col("c_nationkey").alias("grp"), "f1", "f2", "f3", F.col("o_totalprice").alias("target"))


SIGNAL = """signal AS (
  SELECT user_id AS record_id, event_id AS seq, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6::DOUBLE AS t,
         value AS x, (props->>'$.k')::DOUBLE AS y, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i
  FROM events)"""

TRACKS = """points AS (SELECT vec_id AS frame, embedding, unnest(range(0, 32)) AS point_id FROM embeddings),
tracks AS (
  SELECT frame, point_id, embedding[2 * point_id + 1]::DOUBLE * 10.0::DOUBLE AS x, embedding[2 * point_id + 2]::DOUBLE * 10.0::DOUBLE AS y, (frame + point_id) % 7 <> 0 AS visible
  FROM points),
ref AS (SELECT point_id, x AS x0, y AS y0 FROM tracks WHERE frame = 0)"""

FEATURES = """sums AS (SELECT l_orderkey, sum(l_quantity) AS f1, count(*)::DOUBLE AS f2, max(l_discount) AS f3 FROM lineitem GROUP BY 1),
feats AS (
  SELECT o_orderkey AS record_id, c_nationkey AS grp, f1, f2, f3, o_totalprice AS target
  FROM orders JOIN sums ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey)"""
