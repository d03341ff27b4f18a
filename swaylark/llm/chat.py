"""Chat formatting after collapse of cumulative snapshots.

Logs often hold a conversation once for each time that it was sent, every snapshot a prefix of the next. The
turns of a conversation up to any one have a rolling hash; a conversation whose last hash is also the hash of
a shorter prefix of another one is dropped by an anti-join, as are repeats of the same conversation. What
stays is rendered.

The rolling hash of a prefix is the exclusive or of its turns' hashes, each salted by the turn's position, in
128 bits. The exclusive or of parts is that of the whole, so a conversation that holds a third of all rows is
dealt to tasks by ranges of (conversation, turn): each range numbers and hashes what it has, and what the
ranges before it hold of the same conversation is added after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

#: Turns in one rendered row; longer conversations have several.
PART = 64
#: Turns in a range, about, where there are more than shuffle partitions ask for.
RANGE = 1 << 20


def _present(name: str) -> list[Column]:
    """A column so that null and empty hash apart."""
    return [F.col(name).isNull(), F.coalesce(F.col(name), F.lit(""))]


def _carried(wide: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``wide`` has a row for each range and conversation of those that lie in several ranges: two a range at most, its first and its last. Returns what the ranges before hold, by range and conversation."""
    spark: SparkSession = wide.sparkSession
    seen: dict = {}
    rows = []
    for r in sorted(wide.collect(), key=lambda r: r["part"]):
        before = seen.get(r["conv_id"], [0] * len(columns))
        rows.append((r["part"], r["conv_id"], *before))
        seen[r["conv_id"]] = [b + r[x] if how == "sum" else b ^ r[x] for b, (x, how) in zip(before, columns.items(), strict=True)]
    return spark.createDataFrame(rows, "part int, conv_id long, " + ", ".join(f"{x}_before long" for x in columns))


def _added(df: DataFrame, before: DataFrame) -> DataFrame:
    before = before.select(F.col("part").alias("_part"), F.col("conv_id").alias("_conv"), *[x for x in before.columns if x.endswith("_before")])
    return df.join(F.broadcast(before), (df["part"] == before["_part"]) & df["conv_id"].eqNullSafe(before["_conv"]), "left").drop("_part", "_conv")


def prefix_hashes(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per turn: part (its range), conv_id, position from 1, h1 and h2 (the rolling hash up to it), role, text."""
    n = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), turns.count() // RANGE)
    order = [F.col(x).asc_nulls_first() for x in ("turn", "role", "text")]
    named = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ranged = C.staged(named.repartitionByRange(n, F.col("conv_id").asc_nulls_first(), *order).withColumn("part", F.spark_partition_id()), "chat-ranges")
    several = ranged.groupBy("conv_id").agg(F.min("part").alias("first"), F.max("part").alias("final")).where("first < final").select(F.col("conv_id").alias("_c"))
    inside = W.partitionBy("part", "conv_id").orderBy(*order)
    wide = ranged.join(several, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    before = _carried(wide.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("held")), {"held": "sum"})
    placed = _added(ranged.withColumn("place", F.row_number().over(inside)), before).withColumn("position", F.col("place") + F.coalesce("held_before", F.lit(0)))
    salted = [F.xxhash64(F.lit(k), F.col("position"), *_present("role"), *_present("text")) for k in (1, 2)]
    upto = W.partitionBy("part", "conv_id").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    hashed = placed.withColumns({"s1": salted[0], "s2": salted[1]})
    hashed = C.staged(hashed.select("part", "conv_id", "position", "s1", "s2", F.bit_xor("s1").over(upto).alias("p1"), F.bit_xor("s2").over(upto).alias("p2"), "role", "text"), "chat-hashes")
    wide = hashed.join(several, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    before = _carried(wide.groupBy("part", "conv_id").agg(F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2")), {"s1": "xor", "s2": "xor"})
    h1, h2 = (F.col(f"p{k}").bitwiseXOR(F.coalesce(f"s{k}_before", F.lit(0))) for k in (1, 2))
    return _added(hashed, before).select("part", "conv_id", "position", h1.alias("h1"), h2.alias("h2"), "role", "text")


def maximal(hashed: DataFrame) -> DataFrame:
    """The conversations that prefix no other: conv_id, n_turns, and how many conversations are alike. Of equal ones the smallest id stays."""
    last = hashed.groupBy("conv_id").agg(F.max(F.struct("position", "h1", "h2")).alias("last"))
    ends = last.groupBy(F.col("last.position").alias("n_turns"), F.col("last.h1").alias("h1"), F.col("last.h2").alias("h2")).agg(F.min(F.struct("conv_id")).alias("least"), F.count(F.lit(1)).alias("n_alike"))
    reach = hashed.groupBy(F.col("position").alias("n_turns"), "h1", "h2").agg(F.count(F.lit(1)).alias("n_reach"))
    longer = reach.join(ends, ["n_turns", "h1", "h2"]).where("n_reach > n_alike").select("n_turns", "h1", "h2")
    return ends.join(longer, ["n_turns", "h1", "h2"], "left_anti").select(F.col("least.conv_id").alias("conv_id"), "n_turns", "n_alike")


def render_turn(role: Column, text: Column) -> Column:
    """One turn as text; a null role is ``unknown``, a null text empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def format_chats(turns: DataFrame, conv: str = "conv_id", part: int = PART) -> DataFrame:
    """Rendered maximal conversations: conv_id, part_no from 0, n_turns, n_alike, chat.

    Turns are in order of turn, role and text, nulls first; a repeated turn counts as a turn. Rows of null
    conv_id are one conversation. Null and empty roles and texts differ in the comparison. A conversation of
    more than ``part`` turns has several rows, so that no row grows without bound. Empty tables give no rows;
    further columns are not looked at.
    """
    hashed = prefix_hashes(turns, conv)
    kept = maximal(hashed)
    kept = kept.select(F.col("conv_id").alias("_kept"), "n_turns", "n_alike")
    lines = hashed.join(kept, hashed["conv_id"].eqNullSafe(kept["_kept"])).select("conv_id", F.floor((F.col("position") - 1) / part).alias("part_no"), "n_turns", "n_alike", F.struct("position", render_turn(F.col("role"), F.col("text")).alias("line")).alias("turn"))
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list("turn")), lambda x: x["line"]))
    return lines.groupBy("conv_id", "part_no", "n_turns", "n_alike").agg(joined.alias("chat"))
