"""Recordings played one after the other, again and again, as a table or a stream.

A playlist is a list of Parquet files (or what pyarrow opens under their names) with samples in order. An offset is the number of samples
played so far, over all items and loops, from which item, loop and place follow; a stream plays ``rate`` samples a second from ``start`` on, so
offsets need no memory of their own and a query that starts again goes on where it was. Each item of each loop is a record of its
own: what is kept by record (filters, blocks, derivatives) begins anew at each boundary.
"""

from __future__ import annotations

import json
import time
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

#: What a row of an item gets besides its own columns: the record (loop x items + item), both of these, its place from 0, and whether an item begins with it.
ADDED = StructType([StructField("record_id", LongType()), StructField("item", IntegerType()), StructField("loop", IntegerType()), StructField("place", LongType()), StructField("boundary", BooleanType())])
#: Rows that a task reads.
SLICE = 1 << 20


@dataclass
class Part(InputPartition):
    """Rows ``first`` to ``last`` (after the end) of an item in a loop."""

    item: int
    loop: int
    first: int
    last: int


class _Player:
    """Where in the playlist a number of samples leads. Counts come from the files' footers."""

    def __init__(self, options: dict, schema: StructType):
        self.schema, self.paths, self.loops = schema, json.loads(options["items"]), int(options.get("loops", "1"))
        self.rate, self.start = float(options.get("rate", "30")), float(options.get("start", "0"))
        if not self.paths or self.loops < 1 or self.rate <= 0:
            raise ValueError("a playlist has items, a loop at least and a rate above 0")
        self.sizes: list[int] | None = None

    def ends(self) -> list[int]:
        if self.sizes is None:
            self.sizes = [pq.ParquetFile(p).metadata.num_rows for p in self.paths]
        return list(accumulate(self.sizes))

    def parts(self, start: int, end: int) -> list[Part]:
        ends, out = self.ends(), []
        while start < end:
            loop, place = divmod(start, ends[-1])
            item = bisect_right(ends, place)
            first = place - (ends[item] - self.sizes[item])
            last = min(self.sizes[item], first + (end - start), (first // SLICE + 1) * SLICE)
            out.append(Part(item, loop, first, last))
            start += last - first
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema.fields if f.name not in ADDED.names]
        at = 0
        for batch in pq.ParquetFile(self.paths[part.item]).iter_batches(columns=names):
            first, last = max(part.first, at), min(part.last, at + batch.num_rows)
            if first < last:
                own, n = batch.slice(first - at, last - first), last - first
                places = pa.array(range(first, last), pa.int64())
                added = {"record_id": pa.array([part.loop * len(self.paths) + part.item] * n, pa.int64()), "item": pa.array([part.item] * n, pa.int32()), "loop": pa.array([part.loop] * n, pa.int32()), "place": places, "boundary": pa.array([i == 0 for i in range(first, last)])}
                yield pa.RecordBatch.from_arrays([added[f.name] if f.name in added else own.column(own.schema.get_field_index(f.name)) for f in self.schema.fields], names=self.schema.names)
            at += batch.num_rows
            if at >= part.last:
                break


class PlaylistReader(_Player, DataSourceReader):
    def partitions(self) -> list[Part]:
        return self.parts(0, self.loops * self.ends()[-1])


class PlaylistStreamReader(_Player, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"samples": 0}

    def latestOffset(self) -> dict:
        played = int(max(0.0, time.time() - self.start) * self.rate)
        return {"samples": min(played, self.loops * self.ends()[-1])}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.parts(start["samples"], end["samples"])

    def commit(self, end: dict) -> None:
        pass


class Playlist(DataSource):
    """Format ``playlist``. Options: items (a JSON list of paths), loops (1), and for streams rate (30 samples a second) and start (seconds since 1970; 0, so all is there at once). The schema is that of the items' columns that are asked for, and any of ADDED."""

    @classmethod
    def name(cls) -> str:
        return "playlist"

    def reader(self, schema: StructType) -> PlaylistReader:
        return PlaylistReader(self.options, schema)

    def streamReader(self, schema: StructType) -> PlaylistStreamReader:
        return PlaylistStreamReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Playlist)


def playlist_schema(columns: str) -> StructType:
    """The items' columns, as ``name type, ...``, and all of ADDED."""
    return StructType([*StructType.fromDDL(columns).fields, *ADDED.fields])
