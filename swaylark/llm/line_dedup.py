"""Line dedup by content-defined chunks of lines.

Each line has a hash; a rolling hash over the last few lines ends a chunk where it meets a fixed pattern, so
that lines put in or left out move the boundaries near them only. Chunks of several lines that occur more
than once in all documents are removed but for their first occurrence (the least id, then place).

Chunks are nested: under the coarse ones lie, with ``pairs``, those of the finest level, every two adjacent lines (a
rolling hash of two lines that ends a chunk everywhere), so that a repeated passage that no coarse chunk falls into whole is
found too: of each run of two or more lines that occurs elsewhere all copies but the first go. No coarser level
can promise that, as the boundaries of a chunk of two lines would hang on lines outside the run.

No chunk is looked at that holds a line that occurs once. So lines are counted first, by hash, and a document's
chunks are those whose every line is repeated. They are grouped by their bytes, combined within each task first;
only what repeats is joined back. A row is known by its id and 128 bits of its text's hash, so rows that share an id, or have none, keep
their own lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Lines that the rolling hash looks at.
WINDOW = 2
#: A chunk ends at one of this many places on average.
MEAN_LINES = 3
#: A chunk of fewer lines is never removed.
LEAST_LINES = 2
MASK = (1 << 64) - 1
MULTIPLIER = 0x9E3779B97F4A7C15
#: Bytes of chunks that a task combines before it hands them on.
COMBINE = 24 << 20
#: Places from here on are those of the finest level: this and the first line's number.
PAIR = 1 << 30
#: What tells rows apart.
ROW = ["doc", "k1", "k2"]
ROW_TYPE = "doc long, k1 long, k2 long"


def line_hashes(lines: list[bytes]) -> list[int]:
    return [xxhash.xxh64_intdigest(x) for x in lines]


def chunks(text: bytes) -> list[tuple[int, int, int]]:
    """(first byte, byte after, lines) of each chunk; a line's break belongs to it."""
    lines = text.split(b"\n")
    out, start, at, count = [], 0, 0, 0
    hashes = line_hashes(lines)
    last = len(lines) - 1
    out_factor = pow(MULTIPLIER, WINDOW, 1 << 64)
    rolling = 0
    for i, line in enumerate(lines):
        rolling = (rolling * MULTIPLIER + hashes[i]) & MASK
        if i >= WINDOW:
            rolling = (rolling - hashes[i - WINDOW] * out_factor) & MASK
        at += len(line) + (i < last)
        count += 1
        if i == last or ((rolling * MULTIPLIER & MASK) >> 33) % MEAN_LINES == 0:
            out.append((start, at, count))
            start, count = at, 0
    return out


def _trimmed(chunk: bytes) -> bytes:
    """Without its last line break, so that a chunk at a text's end equals one within."""
    return chunk[:-1] if chunk.endswith(b"\n") else chunk


def units(text: bytes, pairs: bool, common: set[int]) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of each chunk of several lines, then of each two adjacent lines, if the numbers of all its lines are in ``common``."""
    first = 0
    for place, (a, b, n) in enumerate(chunks(text)):
        if n >= LEAST_LINES and all(i in common for i in range(first, first + n)):
            yield place, _trimmed(text[a:b])
        first += n
    if pairs:
        lines = text.split(b"\n")
        for i in sorted(common):
            if i + 1 in common:
                yield PAIR + i, lines[i] + b"\n" + lines[i + 1]


def digest(place: int, unit: bytes) -> bytes:
    """SHA-256 of a unit and its level: a coarse chunk of two lines and the finest one at its place are two units."""
    return hashlib.sha256((b"fine" if place >= PAIR else b"coarse") + unit).digest()


def lines_gone(lines: list[bytes], found: list[tuple[int, int, int]], gone: set[int]) -> set[int]:
    """The numbers of the lines that go with the units at these places."""
    out, start = set(), 0
    for place, (_, _, n) in enumerate(found):
        if place in gone:
            out.update(range(start, start + n))
        start += n
    for i in (x - PAIR for x in gone if x >= PAIR):
        # of equal lines in a row the first two stay: a later pair may begin within the first one
        if not (i and PAIR + i - 1 not in gone and lines[i - 1] == lines[i] == lines[i + 1]):
            out.add(i)
        out.add(i + 1)
    return out


def _repeated_lines(texts: DataFrame) -> DataFrame:
    """ROW and ``common``, the numbers of the lines whose hash occurs more than once in all texts, of rows in which two such lines are adjacent."""
    counts, places = pa.schema([("h", pa.int64()), ("n", pa.int64())]), pa.schema([("doc", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("h", pa.int64()), ("at", pa.list_(pa.int32()))])

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for t in C.values(batch, "body"):
            yield np.array(line_hashes(t.split(b"\n")), np.uint64).view(np.int64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = np.unique(np.concatenate(list(hashes(batch))), return_counts=True)
            yield C.batch_of(counts, h, n)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of, at = [], [], []
            for i, h in enumerate(hashes(batch)):
                if len(h) >= LEAST_LINES:
                    own, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
                    rows.append(np.full(len(own), i))
                    of.append(own)
                    at += np.split(np.argsort(inverse, kind="stable").astype(np.int32), np.cumsum(n)[:-1])
            if rows:
                keys = batch.select(ROW).take(pa.array(np.concatenate(rows)))
                yield C.batch_of(places, *keys.columns, np.concatenate(of), pa.array(at, pa.list_(pa.int32())))

    bodies = texts.where(F.contains("body", F.lit(b"\n")))  # a text of one line has no chunk
    common = bodies.select("body").mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    # by shuffle at any size
    seen = bodies.mapInArrow(placed, f"{ROW_TYPE}, h long, at array<int>").hint("merge").join(common, "h")
    flags = seen.groupBy(*ROW).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("common"))
    return flags.where(F.exists(F.arrays_zip("common", F.slice("common", 2, F.greatest(F.size("common"), F.lit(1))).alias("next")), lambda x: x["next"] - x["common"] == 1))


def _many(marked: DataFrame, pairs: bool) -> DataFrame:
    """Each task's distinct units by their bytes, occurrences, and the first of them."""
    schema = pa.schema([("sha", pa.binary()), ("chunk", pa.binary()), ("doc", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("place", pa.int32()), ("n", pa.int64())])

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        found = list(held.items())
        for i in range(0, len(found), 4096):
            part = found[i : i + 4096]
            firsts = [v[0] for _, v in part]
            yield C.batch_of(schema, [digest(v[0][3], x) for (_, x), v in part], [x for (_, x), _ in part], *([f[k] for f in firsts] for k in range(4)), [v[1] for _, v in part])

    def order(at: tuple) -> tuple:
        return at[0] is None, at[0] or 0, *at[1:]

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bool, bytes], list] = {}
        size = 0
        for batch in batches:
            for *row, text, common in zip(*(C.values(batch, x) for x in (*ROW, "body", "common")), strict=True):
                for place, unit in units(text, pairs, set(common)):
                    at, level = (*row, place), (place >= PAIR, unit)
                    if (got := held.get(level)) is None:
                        held[level] = [at, 1]
                        size += len(unit)
                    else:
                        got[1] += 1
                        if order(at) < order(got[0]):
                            got[0] = at
            if size > COMBINE:
                yield from flush(held)
                held, size = {}, 0
        yield from flush(held)

    return marked.mapInArrow(combined, f"sha binary, chunk binary, {ROW_TYPE}, place int, n long")


def _repeated(many: DataFrame) -> DataFrame:
    """Units that occur more than once, by their bytes: sha, and the first occurrence."""
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), *ROW, "place")).alias("first")
    return many.groupBy("sha", "chunk").agg(F.sum("n").alias("n"), first).where("n > 1").select("sha", *(F.col(f"first.{x}").alias(f"first_{x}") for x in (*ROW, "place")))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", pairs: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_removed (lines), n_chunks_removed, text (what stays).

    With ``pairs`` chunks have a finest level, every two adjacent lines. A line's first occurrence of all
    then stays always, and of equal lines in a row two. n_chunks_removed counts coarse chunks that repeat as a whole.
    Null texts count as empty, which is one line; they stay empty. Rows that share an id, or have none, are rows of
    their own; those that share an id and a text hold their chunks at the same place, so both keep a first
    occurrence. Null ids come last. Columns may have any names. Empty tables give no rows.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    texts = docs.select(F.col(key).cast("long").alias("doc"), C.body(text).alias("body")).withColumns({"k1": F.xxhash64("body"), "k2": F.xxhash64(F.lit(1), "body")})
    out_schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_chunks_removed", pa.int64()), ("text", pa.string())])

    def on_row(table: DataFrame, other: DataFrame, how: str) -> DataFrame:
        named = other.toDF(*(f"_{c}" for c in other.columns)).hint("merge")  # by shuffle at any size
        return table.join(named, (table["k1"] == named["_k1"]) & (table["k2"] == named["_k2"]) & table["doc"].eqNullSafe(named["_doc"]), how)

    marked = C.staged(on_row(texts, _repeated_lines(texts), "inner").select(*ROW, "body", F.col("_common").alias("common")), "line-marked")
    repeated = C.staged(_repeated(_many(marked, pairs)), "line-repeats")
    schema = pa.schema([("doc", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("place", pa.int32()), ("sha", pa.binary())])

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*row, place, digest(place, unit)) for *row, t, common in zip(*(C.values(batch, x) for x in (*ROW, "body", "common")), strict=True) for place, unit in units(t, pairs, set(common))]
            if rows:
                yield C.batch_of(schema, *map(list, zip(*rows, strict=True)))

    seen = marked.mapInArrow(occurrences, f"{ROW_TYPE}, place int, sha binary")
    later = ~(F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("k1") == F.col("first_k1")) & (F.col("k2") == F.col("first_k2")) & (F.col("place") == F.col("first_place")))
    places = C.staged(seen.join(repeated, "sha").where(later).groupBy(*ROW).agg(F.array_sort(F.collect_set("place")).alias("places")), "line-gone")
    C.unstage(marked, repeated)
    joined = on_row(texts, places, "left").select("doc", "body", F.col("_places").alias("places"))

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, t, drop in zip(*(C.values(batch, x) for x in ("doc", "body", "places")), strict=True):
                if not drop:
                    rows.append((doc, t.count(b"\n") + 1, 0, 0, t.decode()))
                    continue
                gone, found, lines = set(drop), chunks(t), t.split(b"\n")
                out = lines_gone(lines, found, gone)
                kept = b"\n".join(x for i, x in enumerate(lines) if i not in out)
                rows.append((doc, len(lines), len(out), sum(place < PAIR for place in gone), kept.decode()))
            yield C.batch_of(out_schema, *map(list, zip(*rows, strict=True)))

    return joined.mapInArrow(rebuilt, "doc_id long, n_lines long, n_removed long, n_chunks_removed long, text string")
