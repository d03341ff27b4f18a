"""Connected components of a graph of links, by alternating star contraction in DataFrame joins.

Each round hangs every node's larger neighbours on the least node that it knows (large star), then its
smaller ones (small star); after a few rounds every component is one star around its least node. A hub's
links are never gathered: a round joins them to the least neighbour, which is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Links of which a task keeps those that join two of its trees.
TREE_LINKS = 1 << 18


class Sets:
    """Disjoint sets of ids."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = x = self.above.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.find(x), self.find(y)
        self.above[y] = x
        return x != y


def forest(links: DataFrame) -> DataFrame:
    """Fewer of the links that connect the same nodes: each task keeps what joins two trees of its share."""
    parts = max(4, links.count() // TREE_LINKS)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for batch in batches:
            new = [sets.join(u, v) for u, v in zip(C.values(batch, "u"), C.values(batch, "v"), strict=True)]
            yield batch.filter(pa.array(np.array(new, bool)))

    return links.repartition(parts, F.xxhash64("u", "v")).mapInArrow(kept, links.schema)


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Of links (u, v): each linked node and the least node of its component, as columns node and root.

    Links may repeat and point either way; links of a node to itself and null ends are passed over.
    """
    links = C.staged(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "links")
    links, whole = C.staged(forest(links), "links"), links
    C.unstage(whole)
    before = None
    for _ in range(most):
        last, links = links, C.staged(_small_star(_large_star(links)), "links")
        C.unstage(last)
        state = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        now = (state["n"], state["x"])
        if now == before or not state["n"]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
