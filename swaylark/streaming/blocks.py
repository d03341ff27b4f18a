"""Blocks of a fixed number of samples from a stream, record by record.

A record's last samples are kept as list state, a ring that holds what the next block can still begin with. A block
goes out when its last sample comes; a record that ends, by a mark in its rows or because event time has
gone on past it, has its tail filled up to a block, and its state is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

COUNTS = "seen long, block long, t double"


def block_schema(df: DataFrame, key: str, columns: list[str]) -> StructType:
    """What comes out: the key, a sample's own columns, its number in the record, and its place in a block. A refused sample has no block."""
    own = [df.schema[key], df.schema["t"], *(df.schema[c] for c in columns)]
    more = [StructField(n, LongType()) for n in ("i", "block", "place")] + [StructField(n, BooleanType()) for n in ("padded", "rejected")]
    return StructType([StructField(f.name, f.dataType) for f in own] + more)


def cut(rows: pd.DataFrame, seen: int, block: int, width: int, hop: int) -> tuple[list[pd.DataFrame], int]:
    """The full blocks of ``rows`` (numbered by i) from ``block`` on when ``seen`` samples have come, and the number of the next block."""
    out = []
    while block * hop + width <= seen:
        first = block * hop
        part = rows[(rows["i"] >= first) & (rows["i"] < first + width)]
        out.append(part.assign(block=block, place=part["i"] - first, padded=False, rejected=False))
        block += 1
    return out, block


def tail(rows: pd.DataFrame, seen: int, block: int, width: int, hop: int, step: float) -> pd.DataFrame | None:
    """The block that a record's end fills up with repeats of its last sample, whose times go on by the median step of the block's own samples (``step`` for one alone); None if no sample is left over."""
    if seen == 0 or (block and seen <= (block - 1) * hop + width):
        return None
    first = block * hop
    own = rows[rows["i"] >= first].sort_values("i")
    steps = np.diff(own["t"].to_numpy(float))
    step = float(np.median(steps)) if len(steps) else step
    k = np.arange(1, first + width - seen + 1)
    more = own.iloc[np.full(len(k), len(own) - 1)].assign(t=own["t"].iloc[-1] + step * k)
    places = np.concatenate([own["i"].to_numpy() - first, seen - 1 + k - first])
    return pd.concat([own.assign(padded=False), more.assign(padded=True)]).assign(block=block, place=places, rejected=False)


class BlockProcessor(StatefulProcessor):
    """See ``stream_blocks``."""

    def __init__(self, names: list[str], kept: StructType, order: str, end: str | None, event_time: str | None, width: int, hop: int, idle_ms: int, step: float):
        self.names, self.kept, self.order, self.end, self.event_time = names, kept, order, end, event_time
        self.width, self.hop, self.idle_ms, self.step = width, hop, idle_ms, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", self.kept)
        self.counts = handle.getValueState("counts", COUNTS)

    def _load(self) -> tuple[pd.DataFrame, int, int, float | None]:
        seen, block, t = self.counts.get() if self.counts.exists() else (0, 0, None)
        rows = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
        return pd.DataFrame(rows, columns=self.kept.names), seen, block, t

    def _drop(self) -> None:
        self.ring.clear()
        self.counts.clear()
        self._stop_timers()

    def _stop_timers(self) -> None:
        if self.event_time:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, seen, block, last = self._load()
        new = pd.concat(list(rows)).sort_values(["t", self.order], kind="stable", na_position="last")
        t = new["t"].to_numpy(float)
        before = np.fmax.accumulate(np.concatenate([[-np.inf if last is None else last], t]))[:-1]
        good = t > before
        late, new = new[~good], new[good]
        if len(late):
            yield self._shaped(key, late.assign(i=None, block=None, place=None, padded=False, rejected=True))
        new = new.assign(i=np.arange(seen, seen + len(new)))
        own = new[self.kept.names] if not len(held) else pd.concat([held, new[self.kept.names]])
        seen += len(new)
        found, block = cut(own, seen, block, self.width, self.hop)
        if found:
            yield self._shaped(key, pd.concat(found))
        own = own[own["i"] >= block * self.hop]
        if self.end and new[self.end].fillna(False).astype(bool).any():
            filled = tail(own, seen, block, self.width, self.hop, self.step)
            if filled is not None:
                yield self._shaped(key, filled)
            self._drop()
            return
        if seen:
            self.ring.put([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in own.itertuples(index=False)]) if len(own) else self.ring.clear()
            self.counts.update((seen, block, float(new["t"].iloc[-1]) if len(new) else last))
            if self.event_time and len(new):
                self._stop_timers()
                self.handle.registerTimer(int(new[self.event_time].max().timestamp() * 1000) + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, seen, block, _ = self._load()
        filled = tail(held, seen, block, self.width, self.hop, self.step)
        self._drop()
        if filled is not None:
            yield self._shaped(key, filled)

    def _shaped(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(**{self.names[0]: key[0]})
        return rows[self.names].astype({n: "Int64" for n in ("i", "block", "place")})

    def close(self) -> None:
        pass


def stream_blocks(stream: DataFrame, width: int, hop: int, columns: list[str], key: str = "record_id", order: str = "seq", end: str | None = None, event_time: str | None = None, idle: float = 60.0, step: float = 1.0) -> DataFrame:
    """A stream's samples by block of ``width``, one beginning every ``hop``: key, t, ``columns``, i, block, place, padded, rejected.

    Rows need the key, t (seconds) and ``columns``, among them ``order``, which breaks ties of t within a micro-batch. A
    sample that does not come after the record's last one, or has no time, comes back once as rejected, without a block. A record ends with a
    row in which ``end`` is true, or ``idle`` seconds of event time (``event_time``, with a watermark) after its
    last sample; then its tail comes out, filled up as by ``timebase.padded_blocks`` with tail steps, and nothing is kept of it. State is fewer than
    ``width`` samples a record (``hop`` being at most that). The state store must be RocksDB.
    """
    if not 1 <= hop <= width:
        raise ValueError("a block begins at least every width samples")
    if order not in columns:
        raise ValueError("the column that breaks ties must be among the columns")
    if not end and not event_time:
        raise ValueError("records end by a column or by event time; else their state would stay for ever")
    out = block_schema(stream, key, columns)
    kept = StructType([StructField(n, out[n].dataType) for n in ("t", *columns, "i")])
    extra = [c for c in (end, event_time) if c and c not in (key, "t", *columns)]
    rows = stream.select(key, "t", *columns, *extra).withColumn("t", F.col("t").cast(DoubleType()))
    processor = BlockProcessor(out.names, kept, order, end, event_time, width, hop, round(idle * 1000), step)
    return rows.groupBy(key).transformWithStateInPandas(processor, out, "Append", "EventTime" if event_time else "None")
