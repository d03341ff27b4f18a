"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a text with at most k errors (characters changed, added or left out), cut into k + 1
pieces, has a piece that occurs without error. An automaton finds all pieces of all items in one scan of each
text; around every piece found, Myers' bit-parallel algorithm finds the least edit distance between the item
and any stretch of the text. Items are the query set: they go to the tasks in blocks of bounded size, one
scan for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Errors that an item may have, as a share of its characters.
ERROR_RATE = 0.08
#: Characters of items in one block, which each task holds with their automaton.
BLOCK = 4 << 20


def normal(text: str | None) -> str:
    """A-Z lower-cased, runs of ASCII white space one space, ends trimmed."""
    return b" ".join((text or "").encode().lower().split()).decode()


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces of near equal length, with their places."""
    n, parts = len(item), errors + 1
    cuts = [i * n // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def least_distance(eq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance between an item of m characters and any stretch of the text, and where the first such stretch ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, j
                if not best:
                    break
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best, end


class Matcher:
    """Items, the automaton of their pieces and their bit masks."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items = [(i, x, int(len(x) * rate)) for i, x in items if x]
        self.masks: dict[int, dict[str, int]] = {}
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for at, (_, x, errors) in enumerate(self.items):
            for o, piece in pieces(x, errors):
                places.setdefault(piece, []).append((at, o))
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, least distance, where it ends in the normal text) of each item that occurs."""
        if not self.items:
            return []
        spots: dict[int, list[int]] = {}
        for end, (n, found) in self.automaton.iter(text):
            for at, o in found:
                spots.setdefault(at, []).append(end - n + 1 - o)
        out = []
        for at, starts in spots.items():
            item, x, errors = self.items[at]
            place = text.find(x)
            if place >= 0:
                out.append((item, 0, place + len(x)))
                continue
            if not errors:
                continue
            if at not in self.masks:
                self.masks[at] = masks(x)
            best, upto = (errors + 1, 0), -1
            for s in sorted(set(starts)):  # windows that overlap are one
                lo, hi = max(0, s - errors, upto - len(x) - errors), min(len(text), s + len(x) + errors)
                if hi <= upto:
                    continue
                d, e = least_distance(self.masks[at], len(x), text[lo:hi])
                best = min(best, (d, lo + e))
                upto = hi
            if best[0] <= errors:
                out.append((item, *best))
        return out


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for row in benchmark.select(F.col(item).cast("long"), F.col(text)).toLocalIterator():
        x = normal(row[1])
        if held and size + len(x) > BLOCK:
            yield held
            held, size = [], 0
        held.append((row[0], x))
        size += len(x)
    yield held


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """A row per document and item that occurs in it: doc_id, item_id, distance, end_at (in the normal text).

    Both sides are lower-cased (A-Z) and white space runs are one space. An item of n characters may have
    floor(n * rate) errors. Null and empty texts hold nothing; null and empty items occur nowhere. Of equal
    items each has its row, and rows that repeat a document or item repeat theirs. Empty tables give no rows.
    """
    C.small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("end_at", pa.int32())])
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in _blocks(benchmark, item, "text"):

        def found(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for batch in batches:
                hits = [(i, *x) for i, t in zip(C.values(batch, "doc_id"), C.values(batch, "text"), strict=True) if t for x in matcher.find(normal(t))]
                if hits:
                    yield C.batch_of(schema, *map(list, zip(*hits, strict=True)))

        part = texts.mapInArrow(found, "doc_id long, item_id long, distance int, end_at int")
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with all their columns.

    Null and empty texts hold nothing and stay; texts of any length are searched whole; rows that repeat stay or
    go alike, whatever their ids. Null and empty items occur nowhere. Columns may have any names. Empty tables
    stay empty; without items all rows stay.
    """
    C.small_batches(docs.sparkSession)
    out = docs
    for block in _blocks(benchmark, "item_id", "text"):

        def clean(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for batch in batches:
                yield batch.filter(pa.array([not (t and matcher.find(normal(t))) for t in C.values(batch, "text")], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out
