"""Exact dedup through an extendible-hash index on shared files.

Every text has a 64-bit address, the head of its SHA-256. A directory maps the leading bits of an
address to a bucket; a bucket whose texts outgrow its capacity is split in two by one more bit, and the
directory doubles whenever the bucket to split already uses all its bits. Each bucket is a range of addresses.
The buckets lie as files in the shared folder, several for each owner task, dealt by a hash so that owners have
like shares. An owner walks its ranges in address order, chains the texts that share an address and compares
their bytes. Beyond 2 ** MAX_DEPTH buckets of CAPACITY bytes (4 TB) buckets grow instead.

Copies are combined by bytes within each scan task before anything is shuffled, so that a text that fills
a third of the table reaches its owner as a few rows per task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of distinct texts that a bucket may hold before it is split.
CAPACITY = 4 << 20
#: The directory has at most 2 to this power slots, which bounds what the driver and each task hold of it.
MAX_DEPTH = 20
#: Bytes of distinct texts that a scan task combines before it hands them on.
COMBINE = 32 << 20


class Directory:
    """An extendible-hash directory. ``load[i]`` are the bytes whose addresses start with the bits of ``i``."""

    def __init__(self, load: np.ndarray, capacity: int):
        self.load, self.capacity = load, capacity
        self.finest = int(len(load)).bit_length() - 1
        self.depth = 0  # of the directory
        self.slots = np.zeros(1, np.int32)
        self.local = [0]  # bits that each bucket uses
        self.start = [0]  # first prefix of each bucket, in bits of the finest depth

    def size(self, bucket: int) -> int:
        width = 1 << (self.finest - self.local[bucket])
        return int(self.load[self.start[bucket] : self.start[bucket] + width].sum())

    def double(self) -> None:
        self.slots = np.repeat(self.slots, 2)
        self.depth += 1

    def split(self, bucket: int) -> int:
        """Split a bucket by one more bit; returns the new one."""
        if self.local[bucket] == self.depth:
            self.double()
        self.local[bucket] += 1
        new = len(self.local)
        self.local.append(self.local[bucket])
        self.start.append(self.start[bucket] + (1 << (self.finest - self.local[bucket])))
        first = self.start[new] >> (self.finest - self.depth)
        self.slots[first : first + (1 << (self.depth - self.local[new]))] = new
        return new

    def grow(self) -> Directory:
        """Split until every bucket fits, or is a single prefix of the finest depth."""
        waiting = [0]
        while waiting:
            bucket = waiting.pop()
            if self.local[bucket] < self.finest and self.size(bucket) > self.capacity:
                waiting += [bucket, self.split(bucket)]
        return self

    def bucket(self, address: int) -> int:
        """Of an unsigned 64-bit address."""
        return int(self.slots[address >> (64 - self.depth)]) if self.depth else 0


def _address(digest: bytes, bits: int) -> int:
    """The first ``bits`` bits of a digest at the head of 64."""
    return int.from_bytes(digest[:8], "big") >> (64 - bits) << (64 - bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _normal(text: bytes, fold: bool) -> bytes:
    return text.lower() if fold else text  # of bytes, lower() changes A-Z only


def _keys(docs: DataFrame, key: str, text: str, fold: bool, bits: int) -> DataFrame:
    """Per document: its id, address, SHA-256 and bytes."""
    schema = pa.schema([("id", pa.int64()), ("address", pa.int64()), ("sha", pa.binary()), ("size", pa.int64())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_normal(x, fold) for x in C.values(batch, "body")]
            shas = [hashlib.sha256(x).digest() for x in texts]
            yield C.batch_of(schema, C.values(batch, "id"), [_signed(_address(x, bits)) for x in shas], shas, [len(x) for x in texts])

    return docs.select(F.col(key).cast("long").alias("id"), C.body(text).alias("body")).mapInArrow(keyed, "id long, address long, sha binary, size long")


def _directory(keys: DataFrame, capacity: int) -> Directory:
    """Grown from the bytes of distinct texts under each prefix, counted over all of them."""
    distinct = keys.groupBy("address", "sha").agg(F.max("size").alias("size"))
    total = keys.agg(F.sum("size")).first()[0] or 0
    finest = min(MAX_DEPTH, max(4, int(total // capacity).bit_length() + 4))
    prefix = F.shiftrightunsigned("address", 64 - finest).cast("int")
    load = np.zeros(1 << finest, np.int64)
    for row in distinct.groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("size")).collect():
        load[row["prefix"]] = row["size"]
    return Directory(load, capacity).grow()


def _entries(docs: DataFrame, directory: Directory, key: str, text: str, fold: bool, bits: int) -> DataFrame:
    """Texts with their bucket, combined by bytes within each task."""
    schema = pa.schema([("bucket", pa.int32()), ("address", pa.int64()), ("sha", pa.binary()), ("body", pa.binary()), ("last", pa.int64()), ("n", pa.int64())])

    def flush(held: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        texts = list(held)
        for i in range(0, len(texts), 512):
            part = texts[i : i + 512]
            shas = [hashlib.sha256(x).digest() for x in part]
            at = [_address(x, bits) for x in shas]
            yield C.batch_of(schema, [directory.bucket(x) for x in at], [_signed(x) for x in at], shas, part, [held[x][0] for x in part], [held[x][1] for x in part])

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            for i, x in zip(C.values(batch, "id"), C.values(batch, "body"), strict=True):
                x = _normal(x, fold)
                if (got := held.get(x)) is None:
                    held[x] = [i, 1]
                    size += len(x)
                else:
                    got[1] += 1
                    if i is not None and (got[0] is None or i > got[0]):
                        got[0] = i
            if size > COMBINE:
                yield from flush(held)
                held, size = {}, 0
        yield from flush(held)

    return docs.select(F.col(key).cast("long").alias("id"), C.body(text).alias("body")).mapInArrow(combined, "bucket int, address long, sha binary, body binary, last long, n long")


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries in address order: the distinct texts that more than one document has."""
    schema = pa.schema([("address", pa.int64()), ("sha", pa.binary()), ("last", pa.int64()), ("n", pa.int64())])

    def ended(at, chain):
        if at is not None:
            by_sha: dict[bytes, bytes] = {}
            for text, (sha, _, _) in chain.items():
                if by_sha.setdefault(sha, text) != text:
                    raise ValueError("two texts share a SHA-256")
            found = [(at, sha, last, n) for sha, last, n in chain.values() if n > 1]
            if found:
                yield C.batch_of(schema, *map(list, zip(*found, strict=True)))

    at, chain = None, {}
    for batch in batches:
        for a, sha, text, last, n in zip(*(C.values(batch, x) for x in ("address", "sha", "body", "last", "n")), strict=True):
            if a != at:
                yield from ended(at, chain)
                at, chain = a, {}
            if text in chain:  # the same bytes
                _, was, count = chain[text]
                chain[text] = (sha, max((x for x in (was, last) if x is not None), default=None), count + n)
            else:
                chain[text] = (sha, last, n)
    yield from ended(at, chain)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", fold: bool = True, capacity: int = CAPACITY, bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, with ``fold`` after lower-casing A-Z. Of equal texts the row with
    the largest id stays. Null texts count as empty and are one group with the empty ones. A null id counts
    as smaller than any other; rows that repeat an id and a text are told apart by nothing and all stay if
    their id does. An empty table gives no rows. ``bits`` shortens addresses, to test chains.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    keys = C.staged(_keys(docs, key, text, fold, bits), "exact-keys")
    directory = _directory(keys, capacity)
    owners = max(1, min(len(directory.local), max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(directory.local) // 64)))
    name, path = f"exact_index_{uuid.uuid4().hex}", C.scratch(spark, "exact-index")
    try:
        entries = _entries(docs, directory, key, text, fold, bits)
        entries.repartition(owners, "bucket").write.bucketBy(owners, "bucket").sortBy("bucket", "address").option("path", path).saveAsTable(name)
        copies = C.staged(spark.table(name).sortWithinPartitions("bucket", "address").groupBy("bucket").applyInArrow(_chains, "address long, sha binary, last long, n long"), "exact-copies")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    found = copies.select("address", "sha", F.col("last").alias("keep"), "n", F.lit(True).alias("found"))
    keep = F.when(F.col("found"), F.col("keep")).otherwise(F.col("id"))
    return keys.join(found, ["address", "sha"], "left").select(
        F.col("id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Ids should be unique and not null."""
    gone = exact_groups(docs, key, text, **options).where(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
