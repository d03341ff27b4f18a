"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with n documents and target weight w is to give w x total documents, so each of its documents is
repeated w x total / n times on average. How often a document is repeated is drawn from the Poisson
distribution of that mean: a hash of seed and id gives a number in [0, 1), and the count is how many steps of
the cumulative distribution it reaches; a large mean is a sum of such draws. Documents are then exploded by their counts and dealt
to a global order by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources up to this number are broadcast (a few hundred bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Hex digits of a hash that make a uniform number: 13 digits are 52 bits.
DIGITS = 13
#: A larger mean is drawn as the sum of draws of equal means up to this, for exp(-mean) is 0 beyond 745.
LARGEST_MEAN = 500.0
#: Copies of a document that are exploded at once.
RUN = 4096


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) from the seed and the columns' values; nulls count as the word null."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(x.cast("string"), F.lit("null")) for x in columns])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def poisson_steps(mean: Column) -> Column:
    """The cumulative distribution of the Poisson law of this mean, P(0), P(0..1), ..., to where 52 bits see no difference from 1."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("steps"))

    def step(held: Column, k: Column) -> Column:
        term = held["term"] * mean / k
        return F.struct(term.alias("term"), F.concat(held["steps"], F.array(F.element_at(held["steps"], -1) + term)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda held: held["steps"])


def source_rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5, size: float = 1.0) -> DataFrame:
    """Per source: documents, target weight, mean repetition, of how many draws it is the sum, and the Poisson steps of each.

    ``weights`` names target weights by source; sources that it leaves out weigh 0. Without it a source of n
    documents weighs n ** temperature. Weights are scaled to a sum of 1; the mix has about ``size`` times as
    many documents as ``docs``. Null is a source of its own, named by ``""`` in ``weights`` if that is given.
    """
    counts = docs.groupBy(source).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        raw = F.pow("n", F.lit(float(temperature)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        raw = F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(F.col(source), F.lit(""))), F.lit(0.0)) if pairs else F.lit(0.0)
    counts = counts.withColumn("raw", raw)
    totals = counts.agg(F.sum("raw").alias("all_raw"), F.sum("n").alias("all_n")).first()
    weighted = counts.withColumn("weight", F.try_divide("raw", F.lit(totals["all_raw"] or 0.0)))
    rate = F.col("weight") * F.lit(totals["all_n"] or 0.0) * F.lit(float(size)) / F.col("n")
    drawn = weighted.withColumn("mean_repeats", F.coalesce(rate, F.lit(0.0))).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("mean_repeats") / LARGEST_MEAN).cast("int")))
    return drawn.select(F.col(source).alias("_source"), "n", "weight", "mean_repeats", "draws", poisson_steps(F.col("mean_repeats") / F.col("draws")).alias("steps"))


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", weights: dict[str, float] | None = None, temperature: float = 0.5, size: float = 1.0, seed: int = 17, with_order: bool = False) -> DataFrame:
    """The rows of ``docs``, each repeated by its Poisson draw, in a global random order.

    The draw depends on seed and id only, so it holds on any cluster and after any retry. Rows that repeat an
    id are repeated alike; a null id draws as the word null. Null sources are one source. Texts are not
    looked at: null, empty and very long ones pass as they are. An empty table stays empty. Columns may have any
    names. With ``with_order`` the columns copy_no (from 0) and order_key, by which the result is sorted,
    follow; where ``docs`` has columns of these names ours have an underscore more.
    """
    rates = source_rates(docs, source, weights, temperature, size)
    small = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rates = rates.select("_source", F.col("draws").alias("_draws"), F.col("steps").alias("_steps"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[source].alias("_of"), docs[key].alias("_id"))
    joined = rows.join(F.broadcast(rates) if small else rates, rows["_of"].eqNullSafe(rates["_source"]), "inner")
    drawn = joined.withColumn("_u", uniform(seed, F.col("_id")))
    reached = lambda u: F.size(F.filter("_steps", lambda x: x <= u))
    further = F.aggregate(F.sequence(F.lit(1), F.col("_draws") - 1), F.lit(0), lambda held, k: held + reached(uniform(seed, F.col("_id"), k)))
    count = reached(F.col("_u")) + F.when(F.col("_draws") > 1, further).otherwise(0)
    # in runs of RUN copies, so that no array has an entry for each copy of a document that is repeated very often
    runs = drawn.withColumn("_count", count).where("_count > 0").withColumn("_run", F.explode(F.sequence(F.lit(0), F.col("_count") - 1, F.lit(RUN))))
    out = runs.withColumn("_copy", F.explode(F.sequence(F.col("_run"), F.least(F.col("_count"), F.col("_run") + RUN) - 1)))
    out = out.withColumn("_order", uniform(seed + 1, F.col("_id"), F.col("_copy"))).orderBy("_order", "_id", "_copy")
    if not with_order:
        return out.select("_row.*")
    free = lambda name: free(name + "_") if name in docs.columns else name
    return out.select("_row.*", F.col("_copy").alias(free("copy_no")), F.col("_order").alias(free("order_key")))
