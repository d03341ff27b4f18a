"""SimHash near-dedup by the generalised pigeonhole principle.

The 64 bits are grouped into partitions, bits that go together in one partition. Fingerprints that differ in
at most t bits have a partition i in which they differ in at most t_i bits whenever the t_i + 1 sum to t + 1,
where -1 means that the partition is not looked at. Each fingerprint has thresholds of its own: a dynamic
programme over the partitions picks those with the fewest probes and estimated candidates, so that crowded
partition values are passed over and others are probed in a wider ball. Probes meet the fingerprints by
(partition, value); the join keeps pairs that differ in few enough bits.

Only distinct fingerprints are joined; documents come back to them at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import Sets, components

WORDS = 3
DISTANCE = 2
SEED = 42
#: Fingerprints up to this number are cut into 4 partitions of 16 bits, more into 3 of 21 or 22.
WIDE_FROM = 1 << 25
#: A partition's threshold is at most this, which bounds a ball's probes.
RADIUS = 2
#: What a probe costs, in candidates.
PROBE_COST = 2.0
#: What of fingerprints may meet in a place before the place is dealt over several.
MOST = 1 << 16
#: Pairs for each member of a group that meets in a place, beyond which the group is a crowd.
DENSE = 4
#: Documents, and bytes of their shingles' hashes, in a block of a region.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Fingerprints of a document in ``near_dedup``. Sets of Jaccard similarity 0.8 and like size differ in a bit with probability 0.151,
#: so in at most 11 of 64 with 0.74 (seldom less for more similar ones): four independent ones lose 1 pair in 230.
PRINTS = 4
#: Odd factors that mix a hash's bits.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingle_hashes(text: bytes, words: int = WORDS) -> list[int]:
    """XXH64 of each word shingle of the text, A-Z lower-cased."""
    found = text.lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(x) + 1 for x in found])
    starts = [0, *ends[: len(found) - words].tolist()]
    hash_of = xxhash.xxh64_intdigest
    return [hash_of(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]


def fingerprint(hashes: list[int] | np.ndarray) -> int:
    """Bits that more than half of the hashes have, bit 63 first."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Per row: doc_id and fp, the fingerprint as a signed long. Null and empty texts, and those of white space, have 0."""
    C.small_batches(docs.sparkSession)

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(shingle_hashes(x, words)) for x in C.values(batch, "body")], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(batch.schema.get_field_index("doc_id")), "fp": pa.array(fps.view(np.int64))})

    return docs.select(F.col(key).cast("long").alias("doc_id"), C.body(text).alias("body")).mapInArrow(printed, "doc_id long, fp long")


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes of the same values for each k from 1 on; those of 0 are as they are."""
    if not k:
        return hashes
    x = hashes ^ np.uint64(k * MIX[0] & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(MIX[1])
    x = (x ^ x >> np.uint64(27)) * np.uint64(MIX[2])
    return x ^ x >> np.uint64(31)


def several_prints(docs: DataFrame, key: str, text: str, words: int, n: int = PRINTS) -> DataFrame:
    """Per row: doc_id, sha (32 bytes) of the set of shingles, and fp0, fp1, ..., its fingerprints over independent hashes.

    A shingle that repeats counts once, so that none outweighs the rest of the set.
    """
    C.small_batches(docs.sparkSession)
    names = [f"fp{k}" for k in range(n)]

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, shas = [], []
            for x in C.values(batch, "body"):
                hashes = np.unique(np.array(shingle_hashes(x, words), np.uint64))
                shas.append(hashlib.sha256(hashes.tobytes()).digest())
                fps.append([fingerprint(mixed(hashes, k)) for k in range(n)])
            fps = np.array(fps, np.uint64).reshape(-1, n).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(batch.schema.get_field_index("doc_id")), "sha": pa.array(shas, pa.binary())} | {name: pa.array(fps[:, k]) for k, name in enumerate(names)})

    return docs.select(F.col(key).cast("long").alias("doc_id"), C.body(text).alias("body")).mapInArrow(printed, "doc_id long, sha binary" + "".join(f", {x} long" for x in names))


def bits_of(fps: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones per fingerprint, bit 0 (the lowest) first."""
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_products(distinct: DataFrame) -> tuple[np.ndarray, int]:
    """How many fingerprints have both of each two bits, over all of them; and their number."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            x = bits_of(np.asarray(batch.column(0)).view(np.uint64)).astype(np.float32)
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(4097), pa.int32()), "n": pa.array([*total.astype(np.int64).ravel().tolist(), n], pa.int64())})

    out = np.zeros(4097)
    for row in distinct.select("fp").mapInArrow(summed, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row["at"]] = row["n"]
    return out[:4096].reshape(64, 64), int(out[4096])


def group_bits(products: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partitions of near equal width: each begins with the free bit of least total correlation and takes those that go with it most."""
    mean = np.diag(products) / max(n, 1)
    cov = products / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = list(range(64)), []
    for k in range(parts):
        width = (64 * (k + 1)) // parts - (64 * k) // parts
        group = [min(free, key=lambda b: (corr[b, free].sum(), b))]
        free.remove(group[0])
        while len(group) < width:
            nxt = max(free, key=lambda b: (corr[b, group].mean(), -b))
            group.append(nxt)
            free.remove(nxt)
        out.append(sorted(group))
    return out


def part_values(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """The partition's bits of each fingerprint, packed."""
    out = np.zeros(len(fps), np.int64)
    for j, b in enumerate(group):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << j
    return out


def histograms(distinct: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """Per partition: how many fingerprints have each value. At most 2 to the partition's width counts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            for k, group in enumerate(groups):
                seen, n = np.unique(part_values(fps, group), return_counts=True)
                yield pa.RecordBatch.from_pydict({"part": pa.array([k] * len(seen), pa.int32()), "value": pa.array(seen), "n": pa.array(n.astype(np.int64))})

    table = distinct.select("fp").mapInArrow(counted, "part int, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toArrow()
    part, value, n = (np.asarray(table.column(x)) for x in ("part", "value", "n"))
    out = []
    for k, group in enumerate(groups):
        h = np.zeros(1 << len(group), np.int32)
        h[value[part == k]] = n[part == k]
        out.append(h)
    return out


def ball_counts(histogram: np.ndarray, radius: int) -> list[np.ndarray]:
    """By r from 0 to ``radius``: how many fingerprints have a value within r bits of each value."""
    width = len(histogram).bit_length() - 1
    exact = [histogram.astype(np.int64)]  # by distance, bit by bit
    exact += [np.zeros_like(exact[0]) for _ in range(radius)]
    index = np.arange(len(histogram))
    for b in range(width):
        flipped = index ^ (1 << b)
        for r in range(radius, 0, -1):
            # pairs that differ in this bit too: those at r - 1 in the bits before it
            exact[r] = exact[r] + exact[r - 1][flipped]
    return list(np.cumsum(exact, axis=0))


def coded(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte each, an eighth of a power of two apart and rounded up: what tasks hold of them is estimates."""
    return np.ceil(8 * np.log2(1.0 + counts)).astype(np.uint8)


def decoded(codes: np.ndarray) -> np.ndarray:
    return np.exp2(codes / 8.0) - 1


def allocate(costs: np.ndarray) -> np.ndarray:
    """Thresholds per fingerprint and partition. ``costs[i, s, q]``: of threshold s - 1 in partition i; the s sum to the last s.

    Dynamic programming over partitions: the least cost of giving a sum to those so far.
    """
    parts, steps, n = costs.shape
    best = np.full((steps, n), np.inf)
    best[0] = 0
    chosen = np.zeros((parts, steps, n), np.int8)
    for i in range(parts):
        now = np.full((steps, n), np.inf)
        for total in range(steps):
            for s in range(total + 1):
                c = best[total - s] + costs[i, s]
                better = c < now[total]
                now[total] = np.where(better, c, now[total])
                chosen[i, total] = np.where(better, s, chosen[i, total])
        best = now
    out, left = np.zeros((parts, n), np.int8), np.full(n, steps - 1)
    for i in range(parts - 1, -1, -1):
        out[i] = chosen[i, left, np.arange(n)]
        left = left - out[i]
    return out - 1


def _index(distinct: DataFrame, groups: list[list[int]]) -> DataFrame:
    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            fps = np.asarray(column).view(np.uint64)
            for k, group in enumerate(groups):
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(fps), k, np.int32)), "value": pa.array(part_values(fps, group)), "fp": column})

    return distinct.select("fp").mapInArrow(indexed, "part int, value long, fp long")


def _probes(distinct: DataFrame, groups: list[list[int]], counts: list[list[np.ndarray]], distance: int) -> DataFrame:
    radius = min(distance, RADIUS)
    balls = [[sum((1 << b for b in flips), 0) for r in range(radius + 1) for flips in combinations(range(len(g)), r)] for g in groups]
    sizes = [[comb(len(g), r) for r in range(radius + 1)] for g in groups]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            values = [part_values(fps, g) for g in groups]
            costs = np.full((len(groups), distance + 2, len(fps)), np.inf)
            costs[:, 0] = 0
            for i, v in enumerate(values):
                for r in range(radius + 1):
                    costs[i, r + 1] = PROBE_COST * sum(sizes[i][: r + 1]) + decoded(counts[i][r][v])
            for i, thresholds in enumerate(allocate(costs)):
                for r in range(radius + 1):
                    at = np.flatnonzero(thresholds == r)
                    if len(at):
                        ball = np.array(balls[i][: sum(sizes[i][: r + 1])], np.int64)
                        yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(at) * len(ball), i, np.int32)), "value": pa.array((values[i][at][:, None] ^ ball).ravel()), "probe": pa.array(np.repeat(fps[at], len(ball)).view(np.int64))})

    return distinct.select("fp").mapInArrow(probed, "part int, value long, probe long")


def links(distinct: DataFrame, distance: int = DISTANCE, parts: int | None = None) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints (column fp) that differ in at most ``distance`` bits, each once or more."""
    products, n = bit_products(distinct)
    if n < 2:
        return distinct.sparkSession.createDataFrame([], "u long, v long")
    parts = parts or (4 if n < WIDE_FROM or distance >= 3 * (RADIUS + 1) else 3)
    if distance >= parts * (RADIUS + 1):
        raise ValueError("too many bits for the partitions' thresholds")
    groups = group_bits(products, n, parts)
    counts = [[coded(c) for c in ball_counts(h, min(distance, RADIUS))] for h in histograms(distinct, groups)]
    near = (F.col("fp") < F.col("probe")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("probe"))) <= distance)
    index, probes = _index(distinct, groups), _probes(distinct, groups, counts, distance)
    return probes.join(index, (probes["part"] == index["part"]) & (probes["value"] == index["value"]) & near).select(F.col("fp").alias("u"), F.col("probe").alias("v"))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the least id that links reach).

    Null and empty texts have fingerprint 0 and link like any other. Texts of fewer words than a shingle are
    one shingle. Rows that repeat an id are in the components of each of their texts. Null ids are never a
    component's name unless it has no other. Empty tables give no rows.
    """
    prints = C.staged(fingerprints(docs, key, text, words), "simhash-prints")
    distinct = C.staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(links(distinct, distance))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def blocks_of(node: np.ndarray) -> np.ndarray:
    """A hash of each node, by whose remainder it has a block."""
    return (node.view(np.uint64) * np.uint64(MIX[0]) >> np.uint64(33)).astype(np.int64)


def _balls(nodes: DataFrame, groups: list[list[int]], counts: list[list[np.ndarray]], distance: int, most: int) -> DataFrame:
    """Each node (fp, node, region) under all partition values in a ball around its own, with radii of its own choice.

    Two fingerprints meet in partition i if they differ in at most the sum of their radii there. Of two that
    differ in at most t bits some partition does so whenever for both the 2 r_i + 1 sum to t + 1 at least.
    Where more than ``most`` may meet, nodes are in blocks by a hash and every two blocks have a place.
    """
    radii = (0, 1, 2)
    balls = [[np.array([sum((1 << b for b in flips), 0) for k in range(r + 1) for flips in combinations(range(len(g)), k)], np.int64) for r in radii] for g in groups]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, node, region = (np.asarray(batch.column(k)) for k in range(3))
            fps = fps.view(np.uint64)
            block_of = blocks_of(node)
            values = [part_values(fps, g) for g in groups]
            costs = np.full((len(groups), distance + 2, len(fps)), np.inf)
            costs[:, 0] = 0
            for i, v in enumerate(values):
                for r in radii:
                    if 2 * r + 1 <= distance + 1:
                        costs[i, 2 * r + 1] = PROBE_COST * len(balls[i][r]) + decoded(counts[i][r + 1][v])
            for i, s in enumerate(allocate(costs) + 1):
                for r in radii:
                    at = np.flatnonzero(s == 2 * r + 1)
                    if not len(at):
                        continue
                    near = (values[i][at][:, None] ^ balls[i][r]).ravel()
                    who = np.repeat(at, len(balls[i][r]))
                    blocks = 1 + (decoded(counts[i][radii[-1]][near]) // most).astype(np.int64)  # of at most so many that can meet there
                    near, who, of = np.repeat(near, blocks), np.repeat(who, blocks), np.repeat(blocks, blocks)
                    other = np.arange(len(near)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    own = block_of[who] % of
                    place = near | i << 60 | np.minimum(own, other) << 46 | np.maximum(own, other) << 32
                    yield pa.RecordBatch.from_pydict({"place": pa.array(place), "fp": pa.array(fps[who].view(np.int64)), "node": pa.array(node[who]), "region": pa.array(region[who]), "radius": pa.array(np.full(len(who), r, np.int8))})

    return nodes.select("fp", "node", "region").mapInArrow(dealt, "place long, fp long, node long, region long, radius byte")


def _middle(one: np.ndarray, two: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Of the values in both balls the one on the way from ``one``, at its radius or at ``two`` if that is nearer: lowest bits go first."""
    left, flips = one ^ two, np.zeros_like(one)
    for k in range(int(radius.max(initial=0))):
        flips |= np.where(radius > k, left & -left, 0)
        left &= left - 1
    return one ^ flips


def near_rows(fps: np.ndarray, regions: np.ndarray, rows: np.ndarray, distance: int) -> np.ndarray:
    """For each of the rows, which fingerprints are within ``distance`` and of another region."""
    return (np.bitwise_count(fps[rows][:, None] ^ fps[None, :]) <= distance) & (regions[rows][:, None] != regions[None, :])


def meetings(fps: np.ndarray, regions: np.ndarray, distance: int, dense: int = DENSE, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Of fingerprints that meet: pairs (i, j) within ``distance`` and of different regions, all of them; but of groups with more than
    ``dense`` pairs for each member only a star of the members, marked so."""
    n, held, count = len(fps), [], 0
    for a in range(0, n, block):
        rows = np.arange(a, min(a + block, n))
        i, j = np.nonzero(np.triu(near_rows(fps, regions, rows, distance), a + 1))
        count += len(i)
        if count > dense * n:
            break
        held.append((i + a, j))
    else:
        if count:
            yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), False
        return
    left = np.ones(n, bool)
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        group, pairs, at = [start], 0, 0
        while at < len(group):
            rows = np.array(group[at : at + block])
            at += len(rows)
            near = near_rows(fps, regions, rows, distance)
            pairs += int(near.sum())
            new = np.flatnonzero(near.any(0) & left)
            left[new] = False
            group += new.tolist()
        if len(group) < 2:
            continue
        own = np.sort(np.array(group))
        if pairs // 2 > dense * len(own):
            yield np.full(len(own) - 1, own[0]), own[1:], True
            continue
        for a in range(0, len(own), block):
            i, j = np.nonzero(np.triu(near_rows(fps[own], regions[own], np.arange(a, min(a + block, len(own))), distance), a + 1))
            yield own[i + a], own[j], False


def cut(distinct: DataFrame, parts: int = 4) -> tuple[list[list[int]], int]:
    """The bits of each of so many partitions (none for fewer than two fingerprints), and how many fingerprints there are."""
    products, n = bit_products(distinct)
    return (group_bits(products, n, parts) if n > 1 else []), n


def candidates(distinct: DataFrame, distance: int, parts: int = 4, most: int = MOST, dense: int = DENSE, groups: tuple[list[list[int]], int] | None = None) -> DataFrame:
    """Pairs (u, v, crowd) of nodes whose fingerprints are within ``distance`` bits and whose regions differ.

    ``distinct`` has fp, a long node (its fp where it is missing) and a region (its node where it is missing). All pairs
    are there but those of crowds, groups with more than ``dense`` pairs for each member where they meet: of a crowd only
    enough pairs to make it one region. ``groups``: what ``cut`` gives, if that is known.
    """
    groups, n = groups or cut(distinct, parts)
    if n < 2:
        return distinct.sparkSession.createDataFrame([], "u long, v long, crowd boolean")
    if distance + 1 > 5 * parts or (distance + 1 - parts) % 2:
        raise ValueError("the partitions' radii cannot sum to this distance")
    counts = [[coded(c) for c in ball_counts(h, 3)] for h in histograms(distinct, groups)]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5
        known = Sets()  # what this task has made one region

        def own_place(at: int, one: tuple, two: tuple, radius: np.ndarray) -> np.ndarray:
            """Which pairs are told of at this place, one of those of a partition where they meet. Each of a pair: fingerprints and nodes."""
            part, value, low, high = at >> 60, at & 0xFFFFFFFF, at >> 46 & 0x3FFF, at >> 32 & 0x3FFF
            told = _middle(part_values(one[0], groups[part]), part_values(two[0], groups[part]), radius) == value
            if low != high:  # those of one block are told of where it is alone
                blocks = 1 + int(decoded(counts[part][2][np.array([value])])[0] // most)
                told &= blocks_of(one[1]) % blocks != blocks_of(two[1]) % blocks
            return told

        def pairs(place: np.ndarray, fps: np.ndarray, node: np.ndarray, region: np.ndarray, radius: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.diff(place, prepend=-1))
            ends = np.append(starts[1:], len(place))
            out, size = [], 0

            def full() -> pa.RecordBatch:
                u, v, crowd = (np.concatenate(x) for x in zip(*out, strict=True))
                return pa.RecordBatch.from_pydict({"u": pa.array(u), "v": pa.array(v), "crowd": pa.array(crowd)})

            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                for i, j, crowd in meetings(fps[a:b].view(np.uint64), region[a:b], distance, dense):
                    if crowd:
                        new = [known.join(x, y) for x, y in zip(region[a:b][i].tolist(), region[a:b][j].tolist(), strict=True)]
                        i, j = i[new], j[new]
                    else:
                        u, v = a + i, a + j
                        told = own_place(int(place[a]), (fps[u].view(np.uint64), node[u]), (fps[v].view(np.uint64), node[v]), radius[u])
                        i, j = i[told], j[told]
                    out.append((node[a:b][i], node[a:b][j], np.full(len(i), crowd)))
                    size += len(i)
                    if size > 1 << 18:
                        yield full()
                        out, size = [], 0
            if size:
                yield full()

        for batch in batches:
            held = [np.concatenate([x, np.asarray(y)]) for x, y in zip(held, batch.columns, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0
            if last:
                yield from pairs(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if len(held[0]):
            yield from pairs(*held)

    node = F.col("node") if "node" in distinct.columns else F.col("fp")
    nodes = distinct.select("fp", node.alias("node"), (F.col("region") if "region" in distinct.columns else node).alias("region"))
    n_tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 20_000)
    dealt = _balls(nodes, groups, counts, distance, most).repartition(n_tasks, "place").sortWithinPartitions("place", "fp", "node")
    found = dealt.mapInArrow(met, "u long, v long, crowd boolean")
    return found.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("crowd").alias("crowd"))


def crowds(nodes: DataFrame, names: list[str], groups: list[list[list[int]]], distance: int, dense: int = 1, chunk: int = 512) -> DataFrame:
    """Links (u, v) that make regions of nodes that crowd under one value of a partition (``groups``) of one of their fingerprints (``names``).

    Each node is under its own values alone, a row for each, and is compared with at most ``chunk`` neighbours in order of
    fingerprints, so rows and work grow in proportion however large a group is. What this misses ``candidates`` finds; what it
    finds is there no list of pairs.
    """
    if not all(groups):
        return nodes.sparkSession.createDataFrame([], "u long, v long")

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, own in enumerate(groups):
                fps = np.asarray(batch.column(k + 1)).view(np.uint64)
                for i, group in enumerate(own):
                    yield pa.RecordBatch.from_pydict({"place": pa.array(part_values(fps, group) | (k * len(own) + i) << 32), "fp": batch.column(k + 1), "node": batch.column(0)})

    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Sets()
        for batch in batches:
            place, fps, node = (np.asarray(batch.column(k)) for k in range(3))
            starts = np.flatnonzero(np.diff(place, prepend=-1))
            u, v = [], []
            for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(place)], strict=True):
                for a in range(x, y, chunk):
                    some = node[a : min(a + chunk, y)]
                    if len(some) <= 2 * dense + 1:
                        continue  # too few for so many pairs
                    for i, j, crowd in meetings(fps[a : a + len(some)].view(np.uint64), some, distance, dense):
                        new = [crowd and known.join(p, q) for p, q in zip(some[i].tolist(), some[j].tolist(), strict=True)]
                        u.append(some[i][new])
                        v.append(some[j][new])
            if u:
                yield pa.RecordBatch.from_pydict({"u": pa.array(np.concatenate(u)), "v": pa.array(np.concatenate(v))})

    dealt = nodes.select("node", *names).mapInArrow(valued, "place long, fp long, node long")
    n_tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() * len(names) // 100_000)
    ordered = dealt.repartitionByRange(n_tasks, "place", "fp", "node").sortWithinPartitions("place", "fp", "node")
    return ordered.mapInArrow(crowded, "u long, v long")


class Compared:
    """Sets of shingle hashes side by side: how many any two have in common, from one bit for each hash that occurs twice."""

    def __init__(self, sets: list[np.ndarray], most: int = 1 << 26):
        self.sets, self.sizes = sets, np.array([len(x) for x in sets])
        values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1
        width = int((times > 1).sum())
        self.bits = None
        if len(sets) * (width // 64 + 1) * 8 <= most:
            self.bits = np.zeros((len(sets), width // 64 + 1), np.uint64)
            ends = np.cumsum(self.sizes)
            for i, (a, b) in enumerate(zip(ends - self.sizes, ends, strict=True)):
                own = inverse[a:b]
                row = np.zeros(self.bits.shape[1] * 64, np.uint8)
                row[number[own[times[own] > 1]]] = 1
                self.bits[i] = np.packbits(row).view(np.uint64)

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for j in others.tolist()], np.int64)
        return np.bitwise_count(self.bits[others] & self.bits[i]).sum(1, dtype=np.int64)


def linked(sets: list[np.ndarray], fps: np.ndarray, first: np.ndarray, distance: int, least: float) -> list[tuple[int, int]]:
    """Of the pairs (i, j) of which ``first`` has i and not j, or both everywhere if it is all true: enough similar ones to connect what similar ones connect.

    Only pairs near in one of the fingerprints (columns of ``fps``) are compared.
    """
    compared, label, out = Compared(sets), np.arange(len(sets)), []
    inside = first.all()
    for i in np.flatnonzero(first).tolist():
        others = np.arange(i + 1, len(sets)) if inside else np.flatnonzero(~first)
        others = others[label[others] != label[i]]
        n, m = compared.sizes[i], compared.sizes[others]
        others = others[np.minimum(n, m) >= least * np.maximum(n, m)]
        others = others[(np.bitwise_count(fps[others] ^ fps[i]) <= distance).any(1)]
        if not len(others):
            continue
        common = compared.common(i, others)
        hit = others[common >= least * (n + compared.sizes[others] - common)]
        labels, at = np.unique(label[hit], return_index=True)
        out += [(i, j) for j in hit[at].tolist()]
        label[np.isin(label, labels)] = label[i]
    return out


def region_links(regions: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, distance: int, least: float, prints: list[str], count: int = BLOCK, size: int = BLOCK_BYTES) -> DataFrame:
    """Links (u, v) of similar documents within regions: every pair near in a fingerprint is compared.

    ``regions``: node, root; ``nodes``: node and its fingerprints; ``docs``: id, body. A region's documents are dealt to blocks
    of about ``count`` documents and ``size`` bytes of hashes, and every two blocks meet in a task, so no task holds a large
    region; only links that connect come out.
    """
    members = regions.select("node", F.col("root").alias("region")).join(nodes.select("node", *prints).hint("merge"), "node").join(docs.withColumnRenamed("id", "node").hint("merge"), "node")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.array(shingle_hashes(x, words), np.uint64)).tobytes() for x in C.values(batch, "body")]
            kept = batch.select(["region", "node", *prints])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sets, pa.binary())], names=[*kept.schema.names, "hashes"])

    kinds = "".join(f", {x} long" for x in prints)
    held = C.staged(members.select("region", "node", *prints, "body").mapInArrow(hashed, f"region long, node long{kinds}, hashes binary"), "simhash-members")
    total = held.groupBy("region").agg(F.ceil(F.greatest(F.count(F.lit(1)) / count, F.sum(F.octet_length("hashes")) / size)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = held.join(total.hint("merge"), "region").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("region", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") == F.least("own", "other")).alias("first"), "node", *prints, "hashes")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        order = np.argsort(np.asarray(table.column("node")), kind="stable")
        table = table.take(pa.array(order))
        node, sets = np.asarray(table.column("node")), [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        fps = np.stack([np.asarray(table.column(x)) for x in prints], 1).view(np.uint64)
        found = linked(sets, fps, np.asarray(table.column("first")), distance, least)
        if found:
            i, j = np.array(found).T
            yield pa.RecordBatch.from_pydict({"u": pa.array(node[i]), "v": pa.array(node[j])})

    return dealt.groupBy("region", "a", "b").applyInArrow(compared, "u long, v long")


def similar(pairs: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """Of pairs of documents (u, v) those whose sets of word shingles have a Jaccard similarity of ``least``. ``docs``: id, body."""
    one, two = docs.select(F.col("id").alias("u"), F.col("body").alias("body_u")), docs.select(F.col("id").alias("v"), F.col("body").alias("body_v"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, set[int]] = {}  # of the last few texts, as pairs of one document follow each other

        def shingles(x: bytes) -> set[int]:
            if x not in sets:
                if len(sets) > 7:
                    del sets[next(iter(sets))]
                sets[x] = set(shingle_hashes(x, words))
            return sets[x]

        for batch in batches:
            keep = []
            for x, y in zip(C.values(batch, "body_u"), C.values(batch, "body_v"), strict=True):
                s, t = shingles(x), shingles(y)
                keep.append(len(s & t) >= least * len(s | t))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    return pairs.hint("merge").join(one, "u").hint("merge").join(two, "v").select("u", "v", "body_u", "body_v").mapInArrow(judged, "u long, v long")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, distance: int = 11, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` but for near duplicates: one document of each group stays, with all its columns.

    Documents are near duplicates if one of their PRINTS fingerprints over shingles of ``words`` words differs
    in at most ``distance`` bits and their sets of shingles have a Jaccard similarity of ``least`` or more.
    Each distinct set of shingles is a node, named by its least id. Groups are what such links connect; the
    least id stays. Pairs that meet are compared one by one; where many copies of one text crowd, they are a region,
    whose documents are compared in blocks, so that no list of all pairs is made. Texts without a word, null ones too, are one group; texts of fewer
    words than a shingle are one shingle. Texts of any length are read whole. Rows that repeat an id stay or go
    together; rows of a null id stay and are never the one that stays for others. Columns may have any names. An
    empty table stays empty.
    """
    with C.Scope(docs.sparkSession) as scope:
        names = [f"fp{k}" for k in range(PRINTS)]
        prints = C.staged(several_prints(docs, key, text, words), "simhash-prints")
        nodes = C.staged(prints.groupBy("sha", *names).agg(F.min("doc_id").alias("node")).where("node is not null"), "simhash-nodes")
        bodies = docs.select(F.col(key).cast("long").alias("id"), C.body(text).alias("body"))
        cuts = [cut(nodes.withColumnRenamed(name, "fp")) for name in names]
        met = C.staged(crowds(nodes, names, [x for x, _ in cuts], distance), "simhash-crowds")
        regions = components(met).select("node", F.col("root").alias("region"))  # what meets in a region is not looked for
        placed = C.staged(nodes.join(regions.hint("merge"), "node", "left").withColumn("region", F.coalesce("region", "node")), "simhash-placed")
        close = [C.staged(candidates(placed.withColumnRenamed(name, "fp"), distance, groups=x), "simhash-candidates") for name, x in zip(names, cuts, strict=True)]
        pairs = reduce(DataFrame.unionAll, [x.where("not crowd") for x in close])
        crowded = reduce(DataFrame.unionAll, [x.where("crowd").select("u", "v") for x in close], met)
        links = similar(pairs.select("u", "v").distinct(), bodies, words, least)
        if not crowded.isEmpty():
            regions = C.staged(components(crowded), "simhash-regions")
            links = links.unionAll(region_links(regions, nodes, bodies, words, distance, least, names))
        found = components(links)
        rooted = nodes.join(found.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        gone = C.staged(prints.join(rooted.select("sha", "root").hint("merge"), "sha").where("doc_id <> root").select("doc_id"), "simhash-gone")
        scope.keep(C.PATHS[gone])
    gone = gone.hint("merge")
    return docs.join(gone, docs[key].cast("long") == gone["doc_id"], "left_anti")
