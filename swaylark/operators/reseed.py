"""What happens to motion when tracked points are replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ordered, ratio


def innovations(df: DataFrame, value: str = "x", key: str = "record_id") -> DataFrame:
    """Adds jump (distance from the straight continuation of the two samples before) and velocity_jump; null for the first two."""
    w = ordered(key)
    one, two = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    t1, t2 = F.lag("t", 1).over(w), F.lag("t", 2).over(w)
    after, before = ratio(F.col(value) - one, F.col("t") - t1), ratio(one - two, t1 - t2)
    return df.withColumns({"jump": F.abs(F.col(value) - (2 * one - two)), "velocity_jump": F.abs(after - before)})


def at_events(df: DataFrame, events: DataFrame, key: str = "record_id") -> DataFrame:
    """The samples at which events (key, i) lie; those in a record's first two or its last place go."""
    sized = df.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(key)))
    return sized.join(events.select(key, "i").distinct(), [key, "i"]).where("i >= 2 AND i + 1 < _n").drop("_n")


def spikes(df: DataFrame, events: DataFrame, radius: int = 3, value: str = "a", key: str = "record_id") -> DataFrame:
    """Per event (key, i): the sample's value over the median of those within ``radius`` places: spike, baseline, spike_ratio.

    The window goes by place, so it is a row frame and needs no range join.
    """
    near = F.collect_list(value).over(W.partitionBy(key).orderBy("i").rowsBetween(-radius, radius))
    with_near = df.withColumn("_near", F.array_sort(near))
    n = F.size("_near")
    half = F.floor((n - 1) / 2).cast("int")
    upper = F.floor(n / 2).cast("int")
    median = (F.col("_near")[half] + F.col("_near")[upper]) / 2
    hit = at_events(with_near, events, key)
    return hit.select(key, "i", F.col(value).alias("spike"), median.alias("baseline")).withColumn("spike_ratio", F.col("spike") / F.greatest("baseline", F.lit(1e-12)))


def neighbourhood(df: DataFrame, events: DataFrame, seconds: float, key: str = "record_id") -> DataFrame:
    """All samples within ``seconds`` of an event (key, event_t). Times are cut into cells of that length: an event meets three cells of its record by equality."""
    cell = F.floor(F.col("t") / seconds)
    e = events.select(key, "event_t", F.explode(F.array(*[F.floor(F.col("event_t") / seconds) + k for k in (-1, 0, 1)])).alias("cell"))
    return df.withColumn("cell", cell).join(e, [key, "cell"]).where(F.abs(F.col("t") - F.col("event_t")) <= seconds).drop("cell")


def reseed_rows(motion: DataFrame, tracks: DataFrame, events: DataFrame, key: str = "record_id") -> DataFrame:
    """Per event, what its sample does that the two before did not foretell: the twelve columns of a reseed report, and the key.

    ``motion``: key, i (place from 0), t, tx, ty, rotation (radians), ax, ay, quality; ``tracks``: key, i, point_id, x, y;
    ``events``: key, i, reseed_id. Jumps are distances from the straight continuation of the two samples before: of the
    points (mean and 95th percentile over those that have all three samples), of the common shift, and of the rotation in degrees. The spike is
    the size of the acceleration over its median within half a second around, at least three samples to each side,
    counted in the record's median step. Events in a record's first two or its last place go, and so do those whose sample is not there.

    Events are few: each asks for its own samples and points by equality, so no window spans a record's points.
    """
    w, whole = W.partitionBy(key).orderBy("i"), W.partitionBy(key)
    size = F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay"))
    m = motion.withColumns({"_size": size, "_n": F.count(F.lit(1)).over(whole), "_dt": F.col("t") - F.lag("t").over(w)} | {f"_{c}{k}": F.lag(c, k).over(w) for c in ("t", "tx", "ty", "rotation", "quality") for k in (1, 2)})
    far = lambda c: F.col(c) - (2 * F.col(f"_{c}1") - F.col(f"_{c}2"))
    speed = lambda c: ratio(F.col(c) - F.col(f"_{c}1"), F.col("t") - F.col("_t1")) - ratio(F.col(f"_{c}1") - F.col(f"_{c}2"), F.col("_t1") - F.col("_t2"))
    radius = motion.withColumn("_dt", F.col("t") - F.lag("t").over(w)).groupBy(key).agg(F.greatest(F.lit(3), F.rint(ratio(F.lit(0.5), F.percentile("_dt", F.lit(0.5)))).cast("int")).alias("_radius"))
    at = events.select(key, "i", "reseed_id").join(m, [key, "i"]).where("i >= 2 AND i + 1 < _n").join(radius, key)
    near = at.select(key, "i", "reseed_id", F.explode(F.sequence(F.col("i") - F.col("_radius"), F.col("i") + F.col("_radius"))).alias("_j"))
    sizes = motion.select(key, F.col("i").alias("_j"), size.alias("_size")).where(F.col("_size").isNotNull() & ~F.isnan("_size"))
    baseline = near.join(sizes, [key, "_j"]).groupBy(key, "i", "reseed_id").agg(F.percentile("_size", F.lit(0.5)).alias("_baseline"))  # a window's samples
    asked = at.select(key, "i", "reseed_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("_k")).withColumn("_j", F.col("i") - F.col("_k"))
    points = asked.join(tracks.select(key, F.col("i").alias("_j"), "point_id", "x", "y"), [key, "_j"])
    then = lambda c, k: F.max(F.when(F.col("_k") == k, F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))))
    each = points.groupBy(key, "i", "reseed_id", "point_id").agg(*[(then(c, 0) - (2 * then(c, 1) - then(c, 2))).alias(f"_{c}") for c in "xy"])
    jumps = each.withColumn("_jump", F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))).groupBy(key, "i", "reseed_id").agg(F.avg("_jump").alias("point_position_jump_mean_px"), F.percentile("_jump", F.lit(0.95)).alias("point_position_jump_p95_px"))  # a frame's points
    both = at.join(baseline, [key, "i", "reseed_id"], "left").join(jumps, [key, "i", "reseed_id"], "left")
    length = lambda x, y: F.sqrt(x * x + y * y)
    return both.select(
        key, "reseed_id", F.col("i").alias("frame_id"), F.col("t").alias("timestamp"), "point_position_jump_mean_px", "point_position_jump_p95_px", length(far("tx"), far("ty")).alias("common_translation_jump_px"),
        F.degrees(F.abs(far("rotation"))).alias("common_rotation_jump_deg"), length(speed("tx"), speed("ty")).alias("velocity_jump"), F.col("_size").alias("acceleration_spike"),
        (F.col("_size") / F.greatest("_baseline", F.lit(1e-12))).alias("acceleration_spike_ratio"), F.col("_quality1").alias("quality_before"), F.col("quality").alias("quality_after"),
    )


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: name, n, p50, p95 over rows that have it."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("p")).select("p.*").where("v IS NOT NULL")
    return long.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.percentile("v", F.lit(0.5)).alias("p50"), F.percentile("v", F.lit(0.95)).alias("p95"))
