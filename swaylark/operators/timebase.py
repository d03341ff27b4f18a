"""Timestamps: diagnosis, resampling, decimation, hopping blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ordered, ratio


def with_steps(df: DataFrame, key: str = "record_id") -> DataFrame:
    """Adds dt, the time since the sample before; null at a record's first."""
    return df.withColumn("dt", F.col("t") - F.lag("t").over(ordered(key)))


def diagnose(df: DataFrame, key: str = "record_id") -> DataFrame:
    """Per record: samples, nominal step (median), rate, largest and RMS jitter, estimated missing samples.

    Jitter and gaps are measured against the median, so there are two passes, both partitioned by record.
    """
    steps = with_steps(df, key)
    nominal = steps.groupBy(key).agg(F.percentile("dt", F.lit(0.5)).alias("nominal_dt"))
    off = F.col("dt") - F.col("nominal_dt")
    gaps = F.greatest(F.rint(ratio(F.col("dt"), F.col("nominal_dt"))) - 1, F.lit(0.0))
    found = steps.join(nominal, key).groupBy(key, "nominal_dt").agg(F.count(F.lit(1)).alias("sample_count"), F.max(F.abs(off)).alias("max_jitter"), F.sqrt(F.avg(off * off)).alias("rms_jitter"), F.coalesce(F.sum(gaps), F.lit(0.0)).cast("long").alias("missing"))
    return found.withColumn("fps", ratio(F.lit(1.0), F.col("nominal_dt")))


def monotonic_violations(df: DataFrame, key: str = "record_id") -> DataFrame:
    """Samples whose time is not after that of the sample before in arrival order (seq); they are to be rejected."""
    return df.withColumn("before", F.max("t").over(W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, -1))).where("t <= before")


def resample(df: DataFrame, step: float, columns: tuple[str, ...] = ("x",), key: str = "record_id") -> DataFrame:
    """Values on an even grid from each record's first time to its last, by linear interpolation between neighbours.

    Each pair of neighbours makes the grid points between them, so no as-of join is needed. Null values are
    passed over; a record of one sample has one grid point.
    """
    w = ordered(key)
    known = df.where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    pairs = known.select(key, "t", *columns, F.lead("t").over(w).alias("t1"), *[F.lead(c).over(w).alias(f"{c}_1") for c in columns], F.min("t").over(W.partitionBy(key)).alias("t0"))
    lo, hi = F.ceil((F.col("t") - F.col("t0")) / step), F.ceil((F.col("t1") - F.col("t0")) / step) - 1
    hi = F.when(F.col("t1").isNull(), F.floor((F.col("t") - F.col("t0")) / step)).otherwise(hi)
    points = pairs.where(lo <= hi).select("*", F.explode(F.sequence(lo, hi)).alias("k"))
    at = F.col("t0") + F.col("k") * step
    share = F.coalesce(ratio(at - F.col("t"), F.col("t1") - F.col("t")), F.lit(0.0))
    return points.select(key, "k", at.alias("t"), *[(F.col(c) + share * (F.coalesce(F.col(f"{c}_1"), F.col(c)) - F.col(c))).alias(c) for c in columns])


def decimate(df: DataFrame, target_step: float, source_step: float = 0.0, key: str = "record_id") -> DataFrame:
    """Samples that a capture at a target rate emits, with their number (emitted) and even time (at).

    A sample is emitted if the next emission time, emissions so far times ``target_step``, is no more than half a
    ``source_step`` ahead, and never twice. Emissions up to a sample are one more than up to the sample before
    or as many as are due, whichever is less; so they are the place plus the least of what is due less the
    place, over all samples so far: a running minimum.
    """
    w = ordered(key)
    placed = df.withColumn("_i", F.row_number().over(w) - 1)
    due = F.floor((F.col("t") + source_step / 2) / target_step) + 1
    upto = F.col("_i") + F.least(F.lit(1), F.min(due - F.col("_i")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    counted = placed.withColumn("_upto", F.greatest(upto, F.lit(0)))
    rows = counted.withColumn("_before", F.coalesce(F.lag("_upto").over(w), F.lit(0))).where("_upto > _before")
    return rows.select(key, "t", "seq", F.col("_before").cast("long").alias("emitted"), (F.col("_before") * F.lit(float(target_step))).alias("at"))


def hopping_blocks(df: DataFrame, width: int, hop: int, key: str = "record_id") -> DataFrame:
    """A row per sample and full block of ``width`` samples that holds it; a block starts every ``hop`` samples. Needs i."""
    i = F.col("i")
    first, last = F.greatest(F.lit(0), F.ceil((i - width + 1) / hop)), F.floor(i / hop)
    size = F.count(F.lit(1)).over(W.partitionBy(key))
    blocks = df.withColumn("n", size).where(first <= last).withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return blocks.where(F.col("block") * hop + width <= F.col("n")).withColumn("place", F.col("i") - F.col("block") * hop).drop("n")


def finalized(blocks: DataFrame, hop: int, width: int, key: str = "record_id") -> DataFrame:
    """The samples that each block finalizes: its first ``hop``; a record's last block finalizes all it has."""
    marked = blocks.withColumn("_last", F.max("block").over(W.partitionBy(key)))
    return marked.where((F.col("place") < hop) | (F.col("block") == F.col("_last"))).drop("_last").withColumn("reseed_id", F.floor(F.col("block") / 64))


def padded_blocks(df: DataFrame, width: int, hop: int, key: str = "record_id", tail_step: float | None = None) -> DataFrame:
    """As ``hopping_blocks``, with one more block for samples after the last full one, filled up by repeats of the last sample.

    Adds padded; a repeat's time goes on by the record's median step or, with ``tail_step``, by that of the samples in the block
    that is filled up (by ``tail_step`` itself where it has one sample), which is what a stream can know. A record shorter
    than a block has one block.
    """
    i, n = F.col("i"), F.col("_n")
    sized = df.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(key)))
    blocks = F.when(n <= width, F.lit(1)).otherwise(F.ceil((n - width) / hop) + 1)
    first, last = F.greatest(F.lit(0), F.ceil((i - width + 1) / hop)), F.least(F.floor(i / hop), blocks - 1)
    rows = sized.where(first <= last).withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    rows = rows.withColumns({"place": F.col("i") - F.col("block") * hop, "padded": F.lit(False)}).drop("_n")
    steps = with_steps(df, key) if tail_step is None else with_steps(sized.where(i >= (blocks - 1) * hop).drop("_n"), key)
    nominal = steps.groupBy(key).agg(F.coalesce(F.percentile("dt", F.lit(0.5)), F.lit(float(tail_step or 0.0))).alias("_step"))
    ends = sized.where(i == n - 1).withColumns({"block": (blocks - 1).cast("long")}).join(nominal, key)
    short = (F.col("block") * hop + width - n).cast("long")
    repeats = ends.where(short > 0).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), short)))
    repeats = repeats.withColumns({"t": F.col("t") + F.col("_k") * F.col("_step"), "place": F.col("i") + F.col("_k") - F.col("block") * hop, "padded": F.lit(True)}).drop("_n", "_k", "_step")
    return rows.unionByName(repeats)
