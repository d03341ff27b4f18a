"""Removal of repeated byte strings by a sparse suffix array.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too. Not every suffix has to be
sorted: each string of ``length`` bytes holds an anchor, the place of its least hashed k-gram, and equal strings
have equal anchors at equal places. So the suffixes at anchors are enough, each with the bytes before it that a
string can begin with; those whose k-gram occurs in no other place are alone and are set aside.

The suffixes that are left go, as bytes, to buckets between splitters that are sampled from leading tokens (24
bytes). A bucket sorts them by multikey quicksort, tokens of eight bytes one after the other, onwards from the
anchor and, a second time, backwards; neighbours' common lengths then say which suffixes agree in any number of
bytes on both sides, and a string occurs twice if it lies in what two suffixes have in common. A leading token that
many suffixes share (indentation, a rule of dashes) spans several buckets, among which its suffixes are dealt by their whole k-gram. Suffixes of one
k-gram are in one bucket, so no run of equal ones crosses a boundary.

A k-gram with more than MOST different surroundings would fill a bucket. Every string of its own is a key there: its leading 8
bytes and a 16-byte BLAKE2b digest of all of it. Keys are dealt by the same splitters and, where one leading token
spans several, by the digest, so equal strings meet whatever the number of those that only begin alike.

Texts are read in units of about UNIT bytes, a long text in several; a unit hands on each suffix or string once,
with a mark if it has it more often. Copies of whole texts are found by SHA-256 and stand for one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH = 400
#: Bytes of text that are laid out at once.
UNIT = 1 << 19
#: Bytes of text for each bucket of suffixes, about; and most buckets, beyond which a range is dealt further by k-grams.
BUCKET, MOST_BUCKETS = 8 << 20, 4096
#: Surroundings of a k-gram in one bucket.
MOST = 1024
#: Bytes of a suffix that splitters look at.
LEAD = 24
#: One k-gram of an anchor in so many is sampled, and so many samples come to the driver, about.
SAMPLED, SAMPLES = 256, 1 << 16
BASE = 0x9E3779B97F4A7C15
TABLE = np.random.default_rng(2024).integers(0, 1 << 64, 256, dtype=np.uint64)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
PAD = 255


def gram(length: int) -> int:
    """Bytes of an anchor's k-gram."""
    return max(1, length * 2 // 5)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


class Roller:
    """Hashes of stretches of a byte array, as sums of powers of an odd base modulo 2 ** 64. They only propose what bytes then confirm."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                a = np.full(n, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(TABLE[data] * self.down[: len(data)], out=out[1:])
        return out

    def windows(self, sums: np.ndarray, k: int) -> np.ndarray:
        return mixed((sums[k:] - sums[:-k]) * self.up[: len(sums) - k])

    def stretches(self, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((sums[hi] - sums[lo]) * self.up[lo])


def sliding(x: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """Least or greatest of each w neighbours, from running ones within blocks of w."""
    if w == 1:
        return x
    n = len(x) - w + 1
    padded = np.concatenate([x, np.full(-len(x) % w, fill, x.dtype)]).reshape(-1, w)
    ahead = op.accumulate(padded, axis=1).ravel()
    behind = op.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[w - 1 : w - 1 + n])


def units(sizes: list[int], length: int, most: int) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Stretches (text, start, end, from, to) of about ``most`` bytes in all: its own part of a text, and with what anchors there look at."""
    back, held, size = length - gram(length), [], 0
    for row, n in enumerate(sizes):
        for s in range(0, n, most):
            e = min(n, s + most)
            if held and size + e - s > most:
                yield held
                held, size = [], 0
            held.append((row, s, e, max(0, s - back), min(n, e + length)))
            size += e - s
    if held:
        yield held


class Scanner:
    """A unit's stretches laid end to end, with hashes of all k-grams and the least one of each string of ``length`` bytes."""

    def __init__(self, length: int):
        self.length, self.k, self.roller = length, gram(length), Roller()
        self.back = length - self.k

    def lay(self, bodies: list[bytes], unit: list[tuple[int, int, int, int, int]]) -> None:
        rows, starts, ends, los, his = (np.array(x, np.int64) for x in zip(*unit, strict=True))
        self.data = np.frombuffer(b"".join(bodies[row][lo:hi] for row, _, _, lo, hi in unit), np.uint8)
        sizes = his - los
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.rows, self.shift = rows, los - self.offsets[:-1]  # data place + shift = place in the text
        place = np.arange(len(self.data))
        self.own = (place >= np.repeat(starts - self.shift, sizes)) & (place < np.repeat(ends - self.shift, sizes))
        self.windows = max(0, len(self.data) - self.length + 1)
        self.whole = place[: self.windows] + self.length <= np.repeat(self.offsets[1:], sizes)[: self.windows]
        if self.windows:
            self.sums = self.roller.sums(self.data)
            self.grams = self.roller.windows(self.sums, self.k)
            self.least = sliding(self.grams, self.back + 1, np.minimum, TOP)

    def anchors(self) -> np.ndarray:
        """The unit's own places of k-grams that are the least of a whole window that holds them."""
        if not self.windows:
            return np.zeros(0, np.int64)
        w = self.back + 1
        edge = np.zeros(w - 1, np.uint64)
        most = sliding(np.concatenate([edge, np.where(self.whole, self.least, np.uint64(0)), edge]), w, np.maximum, 0)
        return np.flatnonzero((most[: len(self.grams)] == self.grams) & self.own[: len(self.grams)])

    def stretch_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the surroundings of anchors begin and end."""
        j = self.stretch_of(at)
        return np.maximum(at - self.back, self.offsets[j]), np.minimum(at + self.length, self.offsets[j + 1])

    def surrounding_hashes(self, at: np.ndarray) -> np.ndarray:
        lo, hi = self.around(at)
        return self.roller.stretches(self.sums, lo, hi) ^ mixed((at - lo).astype(np.uint64) * np.uint64(BASE)) ^ (hi - at).astype(np.uint64)

    def bytes_at(self, at: np.ndarray, before: int, after: int) -> np.ndarray:
        """A row of bytes around each place; PAD past the ends of its stretch."""
        j = self.stretch_of(at)
        index = at[:, None] + np.arange(-before, after)
        inside = (index >= self.offsets[j][:, None]) & (index < self.offsets[j + 1][:, None])
        return np.where(inside, self.data[np.clip(index, 0, len(self.data) - 1)], np.uint8(PAD))


def distinct(hashes: np.ndarray, at: np.ndarray, bytes_of: Callable[[np.ndarray], np.ndarray], block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Which of the places stand for all (as indices), and of each place which of those it equals: by hash, confirmed by bytes."""
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    stand = first[inverse]
    differs = np.zeros(len(at), bool)
    doubled = np.flatnonzero(stand != np.arange(len(at)))
    for a in range(0, len(doubled), block):
        i = doubled[a : a + block]
        differs[i] = (bytes_of(at[i]) != bytes_of(at[stand[i]])).any(1)
    stand[differs] = np.flatnonzero(differs)  # of one hash but not of its bytes: stands for itself
    reps = np.unique(stand)
    return reps, np.searchsorted(reps, stand)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of the known, sorted ones."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def tokens(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian numbers of eight."""
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)), constant_values=PAD)
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def multikey_sort(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of tokens, and by place in it how many leading bytes each has in common with the one before.

    Multikey quicksort: runs that agree in the tokens so far are sorted by the next one, each by itself.
    """
    n, width = keys.shape
    order, common, run = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    tied = np.arange(n) if n > 1 else np.zeros(0, np.int64)  # places in the order that are in runs of two or more
    for w in range(width):
        if not len(tied):
            break
        t, of = keys[order[tied], w], run[tied]
        same = of[1:] == of[:-1]
        if (same & (t[1:] != t[:-1])).any():
            by = np.lexsort((t, of))
            order[tied], t = order[tied][by], t[by]
        apart = same & (t[1:] != t[:-1])
        x = t[1:][apart] ^ t[:-1][apart]
        common[tied[1:][apart]] = 8 * w + sum(((x >> np.uint64(8 * b)) == 0).astype(np.int64) for b in range(1, 8))
        head = np.concatenate([[True], ~same | apart])
        starts = np.flatnonzero(head)
        sizes = np.diff(np.append(starts, len(tied)))
        run[tied] = np.repeat(tied[starts], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
    if len(tied):
        follows = run[tied] != tied
        common[tied[follows]] = 8 * width
    return order, common


def shared_windows(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes with bytes before (nearest first) and after the anchor: the fewest and the most bytes before it that a repeated string has, -1 if none.

    ``n_left``, ``n_right``: how many bytes there are; ``many``: whether the suffix occurs more often than here.
    """
    n, back = len(left), left.shape[1]
    fewest, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    sides = []
    for rows in (left, right):
        order, common = multikey_sort(tokens(rows)) if rows.shape[1] else (np.arange(n), np.zeros(n, np.int64))
        reach = np.zeros(n, np.int64)
        reach[order] = np.maximum(common, np.append(common[1:], 0)) if n else 0
        sides.append((order, common, reach))
    lowest, highest = np.maximum(length - n_right, 0), np.minimum(n_left, back)  # strings that there are at all
    alone = lowest <= highest
    fewest[many & alone], most[many & alone] = lowest[many & alone], highest[many & alone]
    (left_order, left_common, left_reach), (right_order, right_common, right_reach) = sides
    open_to = alone & ~many

    def classes(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(common < least)
        return out

    for out, steps in ((fewest, range(back + 1)), (most, range(back, -1, -1))):
        waiting = open_to.copy()
        for x in steps:
            could = (lowest <= x) & (x <= highest) & (left_reach >= x) & (right_reach >= length - x)
            if not (could & waiting).any():
                continue
            # partners that have what they look for, and suffixes that occur more often, count too
            i = np.flatnonzero(could)
            key = classes(left_order, left_common, x)[i] * (n + 1) + classes(right_order, right_common, length - x)[i]
            _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
            hit = i[(times[inverse] > 1) & waiting[i]]
            out[hit], waiting[hit] = x, False
    return fewest, most


def packed(*arrays: np.ndarray) -> bytes:
    parts = [b"".join([a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), a.tobytes()]) for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        kind, n = np.dtype(data[at : at + 4].decode().strip()), int.from_bytes(data[at + 4 : at + 12], "little")
        out.append(np.frombuffer(data, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return out


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of owners, in order, those that overlap or touch as one."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    shift = owner << 40
    upto = np.maximum.accumulate(end + shift)
    head = np.concatenate([[True], start[1:] + shift[1:] > upto[:-1]])
    last = np.append(np.flatnonzero(head)[1:] - 1, len(owner) - 1)
    return owner[head], start[head], upto[last] - shift[last]


def spans(covered: np.ndarray) -> int:
    """Maximal runs of true."""
    return int(np.count_nonzero(np.diff(covered.astype(np.int8), prepend=0) == 1))


def _scan(docs: DataFrame, length: int, unit: int) -> DataFrame:
    """Per document: size, SHA-256, and by anchor its k-gram's hash, how often it occurs and in how many surroundings; and sampled leading tokens."""
    columns = "doc_id long, n_bytes long, sha binary, anchors array<struct<anchor:long,times:long,kinds:long>>, sample array<binary>"
    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("times", pa.int64()), ("kinds", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.binary()), ("anchors", kind), ("sample", pa.list_(pa.binary()))])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(length)
        for batch in batches:
            bodies = C.values(batch, "body")
            rows, anchors, hashes, samples = [], [], [], [[] for _ in bodies]
            for part in units([len(x) for x in bodies], length, unit):
                scanner.lay(bodies, part)
                at = scanner.anchors()
                if not len(at):
                    continue
                rows.append(scanner.rows[scanner.stretch_of(at)])
                anchors.append(scanner.grams[at])
                hashes.append(scanner.surrounding_hashes(at))
                chosen = np.flatnonzero(mixed(anchors[-1] * np.uint64(BASE)) % np.uint64(SAMPLED) == 0)
                _, once = np.unique(anchors[-1][chosen], return_index=True)
                for i in chosen[once]:
                    samples[rows[-1][i]].append(scanner.data[at[i] : at[i] + min(LEAD, scanner.k)].tobytes())
            row, anchor, around = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rows, np.int64), (anchors, np.uint64), (hashes, np.uint64)))
            order = np.lexsort((around, anchor, row))
            row, anchor, around = row[order], anchor[order], around[order]
            first = np.concatenate([[True], (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])]) if len(row) else np.zeros(0, bool)
            new = first | np.concatenate([[True], around[1:] != around[:-1]]) if len(row) else first
            heads = np.flatnonzero(first)
            times = np.diff(np.append(heads, len(row)))
            kinds = np.add.reduceat(new.astype(np.int64), heads) if len(heads) else times
            offsets = np.searchsorted(row[heads], np.arange(len(bodies) + 1))
            items = pa.StructArray.from_arrays([pa.array(anchor[heads].view(np.int64)), pa.array(times, pa.int64()), pa.array(kinds, pa.int64())], ["anchor", "times", "kinds"])
            yield C.batch_of(schema, C.values(batch, "doc_id"), [len(x) for x in bodies], [hashlib.sha256(x).digest() for x in bodies], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items), samples)

    return docs.mapInArrow(scanned, columns)


def _splitters(scanned: DataFrame, n_buckets: int) -> np.ndarray:
    """Leading tokens between which buckets lie, of a bounded sample, in order; one that many suffixes share is there more than once."""
    sampled = scanned.select("sha", F.posexplode("sample").alias("number", "lead")).dropDuplicates(["sha", "number"])  # copies of a text count once
    n = sampled.count()
    chosen = sampled.where(F.abs(F.xxhash64("sha", "number") % 1_000_003) < F.lit(1_000_003.0 * SAMPLES / max(n, 1))).select("lead").limit(4 * SAMPLES).toArrow().column("lead").to_pylist()
    leads = np.sort(np.array(chosen, f"S{LEAD}")) if chosen else np.zeros(0, f"S{LEAD}")
    return leads[np.arange(1, n_buckets) * len(leads) // n_buckets] if len(leads) else leads


def bucket_of(lead: np.ndarray, rest: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """A bucket between splitters; of those that one leading token spans, one by the number ``rest``."""
    lo = np.searchsorted(splitters, lead, "left").astype(np.int64)
    hi = np.searchsorted(splitters, lead, "right").astype(np.int64)
    spread = ((rest >> np.uint64(32)) * (hi - lo + 1).astype(np.uint64)) >> np.uint64(32)
    return np.where(hi > lo, lo + spread.astype(np.int64), lo)


def _numbered(place: np.ndarray) -> np.ndarray:
    """Of each the number among those of its place, in order."""
    order = np.argsort(place, kind="stable")
    p = place[order]
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
    out = np.empty(len(p), np.int64)
    out[order] = np.arange(len(p)) - np.repeat(first, np.diff(np.append(first, len(p))))
    return out


def _by_place(place: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(place, kind="stable")
    cuts = np.flatnonzero(np.diff(place[order], prepend=-1, append=-1)) if len(place) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(place[order[a]]), order[a:b]


def _dealt(texts: DataFrame, length: int, unit: int, splitters: np.ndarray, subs: int) -> DataFrame:
    """Rows of texts (sha, n, anchors, crowded, body) as rows of units: per place the unit's suffixes (place >= 0) or keys (< 0), and without a place where they lie."""
    schema = pa.schema([("unit", pa.int64()), ("place", pa.int64()), ("packed", pa.binary()), ("shas", pa.list_(pa.binary()))])
    back, k = length - gram(length), gram(length)
    short = splitters.astype("S8")

    def of_unit(scanner: Scanner, name: int, shas: list, single: np.ndarray, repeated: np.ndarray, crowded: np.ndarray) -> Iterator[pa.RecordBatch]:
        blobs, marks = [], []
        at = scanner.anchors()
        at = at[among(scanner.grams[at], repeated)] if len(at) else at
        if len(at):
            reps, which = distinct(scanner.surrounding_hashes(at), at, lambda x: scanner.bytes_at(x, back, length))
            many = np.bincount(which) > 1
            head = at[reps]
            lo, hi = scanner.around(head)
            lead = np.ascontiguousarray(scanner.bytes_at(head, 0, min(LEAD, k))).view(f"S{min(LEAD, k)}").ravel()
            further = mixed(scanner.grams[head])  # the same for all suffixes of one k-gram
            place = bucket_of(lead, further, splitters) * subs + (further % np.uint64(subs)).astype(np.int64)
            for p, i in _by_place(place):
                around = np.concatenate([scanner.data[x:y] for x, y in zip(lo[i].tolist(), hi[i].tolist(), strict=True)])
                blobs.append((p, packed(around, (head - lo)[i].astype(np.int32), (hi - head)[i].astype(np.int32), many[i])))
            marks.append((at, place[which], _numbered(place)[which]))
        at = np.flatnonzero(scanner.whole & scanner.own[: scanner.windows] & among(scanner.least, crowded)) if scanner.windows and len(crowded) else np.zeros(0, np.int64)
        if len(at):
            reps, which = distinct(scanner.roller.stretches(scanner.sums, at, at + length), at, lambda x: scanner.bytes_at(x, 0, length))
            many = np.bincount(which) > 1
            data, head = scanner.data.tobytes(), at[reps]
            digests = np.frombuffer(b"".join(hashlib.blake2b(data[x : x + length], digest_size=16).digest() for x in head.tolist()), np.uint64).reshape(-1, 2)
            lead = np.ascontiguousarray(scanner.bytes_at(head, 0, 8)[:, : min(8, length)])
            lead = np.pad(lead, ((0, 0), (0, 8 - lead.shape[1])))
            bucket = bucket_of(lead.view("S8").ravel(), digests[:, 0], short) * subs + (digests[:, 1] % np.uint64(subs)).astype(np.int64)
            for p, i in _by_place(bucket):
                blobs.append((-1 - p, packed(lead[i].ravel(), digests[i].ravel(), many[i])))
            marks.append((at, -1 - bucket[which], _numbered(bucket)[which]))
        if not blobs:
            return
        for p, blob in blobs:
            yield C.batch_of(schema, [name], [p], [blob], [None])
        at, place, number = (np.concatenate(x) for x in zip(*marks, strict=True))
        j = scanner.stretch_of(at)
        owner = scanner.rows[j]
        alone = single[owner]  # of copies nothing is left anyway
        if alone.any():
            kept, owner = np.unique(owner[alone], return_inverse=True)
            yield C.batch_of(schema, [name], [None], [packed(owner.astype(np.int32), (at + scanner.shift[j])[alone], place[alone], number[alone].astype(np.int32))], [[shas[x] for x in kept]])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, name, last = Scanner(length), TaskContext.get().partitionId() << 32, None
        for batch in batches:
            shas = C.values(batch, "sha")
            fresh = [i for i, x in enumerate(shas) if x != (shas[i - 1] if i else last)]  # rows of one id and one text follow each other
            last = shas[-1] if shas else last
            part = batch.take(pa.array(fresh, pa.int64()))
            bodies, shas = C.values(part, "body"), C.values(part, "sha")
            single = np.asarray(C.values(part, "n"), np.int64) == 1
            repeated, crowded = ([np.array(x, np.int64).view(np.uint64) for x in C.values(part, y)] for y in ("repeated", "crowded"))
            for u in units([len(x) for x in bodies], length, unit):
                scanner.lay(bodies, u)
                of = sorted({x[0] for x in u})
                yield from of_unit(scanner, name, shas, single, *(np.unique(np.concatenate([y[i] for i in of])) for y in (repeated, crowded)))
                name += 1

    return texts.mapInArrow(dealt, "unit long, place long, packed binary, shas array<binary>")


def _compare(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One place: per unit, of its suffixes the fewest and most bytes before the anchor of repeated strings, of its keys whether they repeat."""
    back = length - gram(length)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, places, held = [], [], []
        for batch in batches:
            names += C.values(batch, "unit")
            places += C.values(batch, "place")
            held += [unpacked(x) for x in C.values(batch, "packed")]
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        many = columns[-1]
        cuts = np.cumsum([0] + [len(x[-1]) for x in held])
        if places[0] < 0:
            lead, digest = columns[0].reshape(-1, 8), columns[1].reshape(-1, 2)
            order, common = multikey_sort(np.concatenate([tokens(lead), digest], axis=1))
            found = many.copy()
            same = np.flatnonzero(common == 24)
            found[order[same]] = found[order[same - 1]] = True
            out = [packed(found[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        else:
            flat, n_left, n_right = columns[0], columns[1].astype(np.int64), columns[2].astype(np.int64)
            rows = np.full((len(many), back + length), PAD, np.uint8)
            sizes = n_left + n_right
            row = np.repeat(np.arange(len(many)), sizes)
            rows[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(back - n_left, sizes)] = flat
            fewest, most = shared_windows(rows[:, :back][:, ::-1], rows[:, back:], n_left, n_right, many, length)
            out = [packed(fewest[a:b].astype(np.int32), most[a:b].astype(np.int32)) for a, b in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_pydict({"unit": pa.array(names, pa.int64()), "place": pa.array(places, pa.int64()), "packed": pa.array(out, pa.binary())})

    return compared


def _covered(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of units, what was found at each place before where things lie, as repeated stretches of texts."""

    def stretches(found: dict[int, list[np.ndarray]], data: bytes, shas: list) -> pa.RecordBatch | None:
        owner, at, place, number = unpacked(data)
        ends = np.full(len(at), -1, np.int64)
        starts = at.copy()
        for p, i in _by_place(place - place.min()):
            got = found[p + int(place.min())]
            n = number[i]
            if len(got) == 1:
                hit = i[got[0][n]]
                ends[hit] = at[hit] + length
            else:
                fewest, most = got[0][n].astype(np.int64), got[1][n].astype(np.int64)
                hit = fewest >= 0
                starts[i[hit]], ends[i[hit]] = at[i[hit]] - most[hit], at[i[hit]] - fewest[hit] + length
        hit = ends >= 0
        if not hit.any():
            return None
        who, a, b = merged(owner[hit].astype(np.int64), starts[hit], ends[hit])
        cuts = np.searchsorted(who, np.arange(len(shas) + 1))
        of = [j for j in range(len(shas)) if cuts[j + 1] > cuts[j]]
        lists = lambda x: pa.array([x[cuts[j] : cuts[j + 1]] for j in of], pa.list_(pa.int64()))
        return pa.RecordBatch.from_pydict({"sha": pa.array([shas[j] for j in of], pa.binary()), "starts": lists(a), "ends": lists(b)})

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, {}
        for batch in batches:
            for name, place, data, shas in zip(*(C.values(batch, x) for x in ("unit", "place", "packed", "shas")), strict=True):
                if name != at:
                    at, found = name, {}
                if place is not None:
                    found[place] = unpacked(data)
                elif (out := stretches(found, data, shas)) is not None:
                    yield out

    return covered


def _cut(texts: DataFrame, with_text: bool) -> DataFrame:
    """Texts (sha, body, gone: their stretches) without them."""
    schema = pa.schema([("sha", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sha, body, gone in zip(C.values(batch, "sha"), C.values(batch, "body"), C.values(batch, "gone"), strict=True):
                a, b = (np.array([x[y] for x in gone], np.int64) for y in ("starts", "ends"))
                _, a, b = merged(np.zeros(len(a), np.int64), a, b)
                kept = b"".join(body[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(body)], strict=True))
                out.append((sha, int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest()) + (kept,) * with_text)
            if out:
                yield C.batch_of(schema, *map(list, zip(*out, strict=True)))

    return texts.mapInArrow(cut, "sha binary, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_text: bool = False, unit: int = UNIT, bucket: int = BUCKET, most: int = MOST) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` the bytes that stay (kept).

    Strings are judged on the input: of two equal ones both go. Matches never cross rows. Every row counts as a text of its
    own, also where ids repeat or are null, so rows of one text are copies and go whole if they have ``length``
    bytes. Null texts count as empty. Texts shorter than ``length`` stay whole; texts of
    any length are read in units. Empty tables give no rows. Other columns are not looked at, whatever
    their names. What stays may cut a character of several bytes.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), C.body(text).alias("body"))
    scanned = C.staged(_scan(texts, length, unit), "suffix-scan")
    total = scanned.agg(F.sum("n_bytes")).first()[0] or 0
    wanted = max(total // bucket, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    splitters = _splitters(scanned, min(wanted, MOST_BUCKETS))

    copies = scanned.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.max("n_bytes").alias("n_bytes"), F.first("anchors").alias("anchors"))
    copies = C.staged(copies, "suffix-texts")
    seen = copies.select("sha", "doc_id", "n", F.explode("anchors").alias("a")).select("sha", "doc_id", "n", "a.*")
    repeated = seen.groupBy("anchor").agg(F.sum("times").alias("all_times"), F.sum("kinds").alias("all_kinds")).where("all_times > 1")
    repeated = repeated.select("anchor", (F.col("all_kinds") > most).alias("crowd"))
    candidates = seen.join(repeated.hint("merge"), "anchor").groupBy("sha", "doc_id", "n").agg(
        F.collect_list(F.when(~F.col("crowd"), F.col("anchor"))).alias("repeated"), F.collect_list(F.when(F.col("crowd"), F.col("anchor"))).alias("crowded")
    )
    candidates = candidates.select(F.col("sha").alias("_sha"), F.col("doc_id").alias("_doc"), "n", "repeated", "crowded")

    named = texts.withColumn("sha", F.unhex(F.sha2("body", 256)))
    joined = named.join(candidates.hint("merge"), (F.col("sha") == F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    rows = joined.select("sha", "n", "repeated", "crowded", "body").sortWithinPartitions("sha")
    dealt = C.staged(_dealt(rows, length, unit, splitters, max(1, wanted // MOST_BUCKETS)), "suffix-dealt")
    found = dealt.where("place is not null").select("unit", "place", "packed").groupBy("place").applyInArrow(_compare(length), "unit long, place long, packed binary")
    marks = dealt.where("place is null").unionByName(found.withColumn("shas", F.lit(None).cast("array<binary>")))
    lined = marks.repartition("unit").sortWithinPartitions("unit", F.col("place").asc_nulls_last())
    gone = lined.mapInArrow(_covered(length), "sha binary, starts array<long>, ends array<long>")
    gone = gone.groupBy("sha").agg(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("gone")).withColumnRenamed("sha", "_sha")
    stretches = C.staged(gone, "suffix-gone")
    C.unstage(dealt)
    cut = _cut(named.join(stretches.hint("merge"), F.col("sha") == F.col("_sha")).select("sha", "body", "gone"), with_text)

    nothing = F.lit("").cast("binary")
    twins = copies.where((F.col("n") > 1) & (F.col("n_bytes") >= length)).select("sha", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(nothing, 256).alias("kept_sha256"), *([nothing.alias("kept")] * with_text))
    changed = cut.unionByName(twins).withColumnRenamed("sha", "_sha")
    table = named.select("doc_id", "sha", F.octet_length("body").cast("long").alias("n_bytes"), "body") if with_text else scanned.select("doc_id", "n_bytes", "sha")
    out = table.join(changed.hint("merge"), F.col("sha") == F.col("_sha"), "left")
    columns = [F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256")]
    return out.select("doc_id", "n_bytes", *columns, *([F.coalesce("kept", "body").alias("kept")] * with_text))
