"""Clusters around centroids, with ball trees that spare vectors their distances.

Each task packs its vectors into trees of balls once and keeps them as a table in the shared folder: of each ball
the radius, the number of vectors and their integer sum. In a round a ball goes as a whole to one centroid if the
triangle inequality says that all others are farther from every vector in it; otherwise its two halves are
looked at, down to leaves, whose vectors are measured exactly. All sums are of integers, so results do not depend
on how vectors are dealt. What meets on the driver in a round is a row for each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Vectors of a leaf, and of a tree.
LEAF, TREE = 16, 1 << 13
#: Components are multiples of 1 / SCALE, rounded down.
SCALE = 256
#: A component of this size or more, before scaling, has squared distances beyond 64 bits.
TOO_LARGE = 1 << 18
#: Up to this size of an integer component, products of 64-bit floats are exact (for up to 64 components).
EXACT = 1 << 22
#: Room for rounding in distances between a centroid and a ball's middle.
SLACK = 1e-6


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors and centroids."""
    sizes = [int(np.abs(x).max(initial=0)) for x in (vectors, centroids)]
    if max(sizes) <= EXACT and vectors.shape[1] <= 64:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for k, c in enumerate(centroids.astype(np.int64)):
        out[:, k] = ((vectors - c) ** 2).sum(1)
    return out


class BallTree:
    """Vectors in an order in which each ball is a slice: first, last (after the end), left child (the right one follows it; -1 for leaves), sum, radius."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray, first: np.ndarray, last: np.ndarray, child: np.ndarray, sums: np.ndarray, radius: np.ndarray):
        self.vectors, self.order, self.first, self.last, self.child, self.sums, self.radius = vectors, order, first, last, child, sums, radius

    @classmethod
    def of(cls, vectors: np.ndarray) -> BallTree:
        vectors = vectors.astype(np.int64)
        order = np.arange(len(vectors))
        first, last, child, sums, radius, at = [0], [len(vectors)], [], [], [], 0
        while at < len(first):
            i, j = first[at], last[at]
            own = vectors[order[i:j]]
            sums.append(own.sum(0))
            away = np.sqrt(((own - sums[-1] / len(own)) ** 2).sum(1))
            radius.append(float(away.max()) * (1 + 1e-12))
            if j - i <= LEAF or not (own != own[0]).any():
                child.append(-1)
            else:
                # halves along the line between two vectors that are far from each other
                p = own[away.argmax()]
                q = own[((own - p) ** 2).sum(1).argmax()]
                along = own @ (q - p)
                half = (j - i) // 2
                order[i:j] = order[i:j][np.argpartition(along, half)]
                child.append(len(first))
                first += [i, i + half]
                last += [i + half, j]
            at += 1
        return cls(vectors[order], order, np.array(first), np.array(last), np.array(child), np.array(sums), np.array(radius))

    def settled(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Balls that go to one centroid as a whole, and those centroids; then positions of vectors that were measured, and theirs. Of equally near centroids the first counts."""
        balls, whose, near = np.zeros(1, np.int64), [], np.zeros((1, len(centroids)), bool)
        near[0, np.unique(centroids, axis=0, return_index=True)[1]] = True  # of equal centroids only the first can be nearest
        whole, rest = [], []
        targets = centroids.astype(np.float64)
        while len(balls):
            middle = self.sums[balls] / (self.last - self.first)[balls][:, None]
            d = np.sqrt(np.stack([((middle - c) ** 2).sum(1) for c in targets], 1))
            r, slack = self.radius[balls][:, None], SLACK * (1 + d)
            reach = np.where(near, d + slack, np.inf).min(1)[:, None]
            near = near & (d - slack <= reach + 2 * r)
            one, leaf = near.sum(1) == 1, self.child[balls] < 0
            whole.append(balls[one])
            whose.append(near[one].argmax(1))
            rest.append(balls[~one & leaf])
            down = ~one & ~leaf
            balls = np.repeat(self.child[balls[down]], 2) + np.tile([0, 1], int(down.sum()))
            near = np.repeat(near[down], 2, axis=0)
        leaves = np.concatenate(rest)
        n = self.last[leaves] - self.first[leaves]
        places = np.repeat(self.first[leaves] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.concatenate(whole), np.concatenate(whose), places, squared(self.vectors[places], centroids).argmin(1)

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many vectors each centroid has, and their sum."""
        balls, whose, places, labels = self.settled(centroids)
        n, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        np.add.at(n, whose, (self.last - self.first)[balls])
        np.add.at(sums, whose, self.sums[balls])
        np.add.at(n, labels, 1)
        np.add.at(sums, labels, self.vectors[places])
        return n, sums

    def labels(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's centroid and squared distance, in the order in which the vectors were given."""
        balls, whose, places, found = self.settled(centroids)
        own = np.empty(len(self.vectors), np.int64)
        own[places] = found
        for i, j, c in zip(self.first[balls].tolist(), self.last[balls].tolist(), whose.tolist(), strict=True):
            own[i:j] = c
        far = ((self.vectors - centroids[own]) ** 2).sum(1)
        labels, away = np.empty_like(own), np.empty_like(far)
        labels[self.order], away[self.order] = own, far
        return labels, away


PARTS = ("vectors", "order", "first", "last", "child", "sums", "radius")


def whole_vectors(table: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """key and q (integer components) of the vectors that count."""
    x = F.col(column)
    good = (F.size(x) == size) & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < TOO_LARGE)), F.lit(False))
    return table.where(x.isNotNull() & good).select(F.col(key).cast("long").alias("key"), F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("q"))


def ball_trees(vectors: DataFrame, size: int) -> DataFrame:
    """Trees of up to TREE vectors: keys in the order in which they came, and the tree's arrays as bytes."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, n = [], [], 0

        def tree():
            built = BallTree.of(np.concatenate(rows))
            arrays = [np.ascontiguousarray(getattr(built, x), np.float64 if x == "radius" else np.int64 if x == "sums" else np.int32).tobytes() for x in PARTS]
            lists = pa.array([[k for part in keys for k in part]], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([lists, *(pa.array([x], pa.binary()) for x in arrays)], names=["keys", *PARTS])

        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for i in range(0, len(flat), TREE):
                if n + len(flat[i : i + TREE]) > TREE and n:
                    yield tree()
                    keys, rows, n = [], [], 0
                keys.append(batch.column(0).slice(i, TREE).to_pylist())
                rows.append(flat[i : i + TREE])
                n += len(rows[-1])
        if n:
            yield tree()

    return vectors.mapInArrow(packed, "keys array<long>, " + ", ".join(f"{x} binary" for x in PARTS))


def _trees(batch: pa.RecordBatch, size: int) -> Iterator[BallTree]:
    for row in zip(*(C.values(batch, x) for x in PARTS), strict=True):
        arrays = [np.frombuffer(x, np.float64 if name == "radius" else np.int64 if name == "sums" else np.int32) for name, x in zip(PARTS, row, strict=True)]
        arrays[0], arrays[5] = arrays[0].reshape(-1, size).astype(np.int64), arrays[5].reshape(-1, size)
        yield BallTree(*arrays)


def _sums(trees: DataFrame, centroids: np.ndarray, distances: bool) -> dict[int, tuple[int, list[int]]]:
    """Per centroid that has vectors: their number, and their sum (or that of their squared distances)."""
    size = centroids.shape[1]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), 1 if distances else size), np.int64)
        for batch in batches:
            for tree in _trees(batch, size):
                if distances:
                    labels, away = tree.labels(centroids)
                    np.add.at(n, labels, 1)
                    np.add.at(sums[:, 0], labels, away)
                else:
                    more = tree.totals(centroids)
                    n += more[0]
                    sums += more[1]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    width = 1 if distances else size
    parts = trees.mapInArrow(summed, "cluster int, n long, sums array<long>").groupBy("cluster")
    rows = parts.agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).collect()  # a row a centroid
    return {r["cluster"]: (r["n"], [r[f"s{i}"] for i in range(width)]) for r in rows}


def cluster(table: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Per vector that counts: vec_id, cluster, distance (squared, of integer components), cluster_inertia and inertia (distances summed over its cluster and over all), centroid_sha256 (of its centroid's components in decimal, joined by commas).

    The first centroids are the ``k`` vectors of least SHA-256 of the seed and the id (ties: least components; all,
    where there are fewer). Vectors count that have ``size`` components, none null, not finite or of TOO_LARGE or
    more (whose squared distances 64 bits could not hold). Ids that repeat or are null are vectors like others,
    but a null id is no first centroid while there are others. Equal vectors are one ball. Other columns are not read; an empty
    table gives no rows.
    """
    spark = table.sparkSession
    C.small_batches(spark)
    vectors = whole_vectors(table, key, column, size)
    trees = C.staged(ball_trees(vectors, size), "ball-trees")
    named = vectors.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256))
    seeds = named.orderBy(F.col("hash").asc_nulls_last(), "q").limit(k).collect()  # k rows
    out_schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not seeds:
        return spark.createDataFrame([], out_schema)
    centroids = np.array([r["q"] for r in seeds], np.int64)
    for _ in range(rounds):
        for c, (n, sums) in _sums(trees, centroids, False).items():
            centroids[c] = [x // n for x in sums]
    inertia = {c: sums[0] for c, (_, sums) in _sums(trees, centroids, True).items()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("cluster_inertia", pa.int64()), ("inertia", pa.int64()), ("centroid_sha256", pa.string())])
    of_cluster, total = np.array([inertia.get(c, 0) for c in range(len(centroids))], np.int64), sum(inertia.values())

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, tree in zip(C.values(batch, "keys"), _trees(batch, size), strict=True):
                labels, away = tree.labels(centroids)
                yield C.batch_of(schema, keys, labels.astype(np.int32), away, of_cluster[labels], np.full(len(labels), total), [digests[c] for c in labels.tolist()])

    return trees.mapInArrow(assigned, out_schema)
