"""Token ids in Huffman-coded files.

Texts are put in order of doc_id, encoded and kept as blocks of packed ids; a canonical length-limited code
follows from the global counts of ids. Then the blocks are written as shards: each block holds whole documents,
their ids as one bit string, bit-offset checkpoints and the documents' lengths. Shards are Parquet files in the
shared folder with a row for each block; the code is a small table beside them.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import huffman

#: Ids in a block, but for a single document of more.
BLOCK_IDS = 1 << 17
#: Pieces whose ids a worker keeps; beyond that, those that were met least lately go.
KEPT_PIECES = 400_000
#: Bytes of text in a shard, about, where there are more than shuffle partitions ask for.
SHARD = 128 << 20
#: Letters for which composition changes nothing and lower case is a letter for a letter, in lower case.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
#: What texts of such letters and ASCII alone do not have.
ODD = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
#: The same for bytes of Latin-1: white space 0, letters 1, digits 2, others 3; lower case; and the letters of a contraction by its first two.
KINDS = np.array([0 if re.match("[\t-\r ]", chr(b)) else 1 if re.match(f"[{LETTERS}]", chr(b)) else 2 if chr(b) in "0123456789" else 3 for b in range(256)], np.uint8)
LOWER = bytes(ord(chr(b).lower()) for b in range(256))
CONTRACTIONS = np.zeros((256, 256), np.int64)
CONTRACTIONS[[ord(x) for x in "stmd"]] = 1
CONTRACTIONS[[ord(x) for x in "rvl"], [ord(x) for x in "eel"]] = 2
#: The letters that stand for bytes in the vocabulary (itself, if it can be seen); what differs from Latin-1 in them.
SEEN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b != 173]
BYTES = [chr(b) if b in SEEN else chr(256 + b - sum(x < b for x in SEEN)) for b in range(256)]
SPELLED = {chr(b): "".join(BYTES[x] for x in chr(b).encode()) for b in range(256)}
UNUSUAL = re.compile("[^ -~]")
#: Pieces of fewer bytes go by two words, their bytes and their length in the topmost; pieces that the tokenizer has at once; pieces looked up side by side.
LONG, RUN, SIDE = 16, 256, 1 << 18
MASKS = [np.array([(1 << 8 * min(max(n - first, 0), most)) - 1 for n in range(LONG + 1)], np.uint64) for first, most in ((0, 8), (8, 7))]
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
#: White space of str.split that the tokenizer keeps, and what white space is to both.
SEPARATORS = "\x1c\x1d\x1e\x1f"
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: The normalizer and the pattern of the tokenizer whose pieces those are.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def words_of(text: str) -> list[str]:
    """What the tokenizer's white space parts."""
    if any(x in text for x in SEPARATORS):
        return [w for w in SPACE.split(text) if w]
    return text.split()


class PieceTable:
    """Pieces of up to LONG - 1 bytes by two 64-bit words that hold their bytes and their length, so equal words are equal pieces.

    An open-addressing table in numpy: all pieces of a call are looked up at once. Its numbers are places in the arrays of PieceEncoder.
    """

    def __init__(self):
        self.slots = np.full(1 << 14, -1, np.int32)
        self.held, self.keys, self.numbers = 0, np.zeros((2, 1 << 12), np.uint64), np.zeros(1 << 12, np.int32)

    def _slots_of(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys[0] ^ (keys[1] * MIX[0])) * MIX[1]
        mixed ^= mixed >> np.uint64(32)
        return (mixed * MIX[0] >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each piece, or -1."""
        out = np.full(keys.shape[1], -1, np.int64)
        slots, left = self._slots_of(keys), None
        while left is None or len(left):
            at = self.slots[slots]
            seen = np.maximum(at, 0)
            same = (at >= 0) & (self.keys[0][seen] == keys[0]) & (self.keys[1][seen] == keys[1])
            out[np.flatnonzero(same) if left is None else left[same]] = self.numbers[seen[same]]
            on = np.flatnonzero((at >= 0) & ~same)
            left, keys, slots = on if left is None else left[on], keys[:, on], slots[on] + 1 & len(self.slots) - 1
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Pieces that are not in the table, each once."""
        n, m = self.held, keys.shape[1]
        if n + m > len(self.numbers):
            self.keys = np.concatenate([self.keys[:, :n], np.zeros((2, n + 2 * m), np.uint64)], 1)
            self.numbers = np.concatenate([self.numbers[:n], np.zeros(n + 2 * m, np.int32)])
        self.keys[:, n : n + m], self.numbers[n : n + m], self.held = keys, numbers, n + m
        first = n
        if 3 * self.held > len(self.slots):
            self.slots, first = np.full(1 << (4 * self.held).bit_length(), -1, np.int32), 0
        left = np.arange(first, self.held)
        slots = self._slots_of(self.keys[:, left])
        while len(left):
            free = self.slots[slots] < 0
            self.slots[slots[free]] = left[free]
            on = self.slots[slots] != left  # taken, or another of these went there
            left, slots = left[on], slots[on] + 1 & len(self.slots) - 1

    def kept(self, stays: np.ndarray, places: np.ndarray) -> PieceTable:
        """A table of the pieces whose place stays, with their new places."""
        out, on = PieceTable(), np.flatnonzero(stays[self.numbers[: self.held]])
        out.add(self.keys[:, on], places[self.numbers[on]])
        return out


def cut(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of lower-case Latin-1 text start, and their numbers of bytes: what PATTERN finds, for all texts at once.

    Pieces are runs of one kind, single digits, and an apostrophe that begins a run with the letters of CONTRACTIONS after it.
    """
    kinds = KINDS[raw]
    breaks = np.empty(len(raw), bool)
    breaks[:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=breaks[1:])
    breaks |= kinds == 2
    marks = np.flatnonzero((raw == ord("'")) & breaks)
    if len(marks):
        after = np.concatenate([raw, np.zeros(3, np.uint8)])
        size = CONTRACTIONS[after[marks + 1], after[marks + 2]]
        marks, size = marks[size > 0], size[size > 0]
        breaks[marks + 1] = False
        rest = marks + 1 + size
        breaks[rest[rest < len(raw)]] = True
    starts = np.flatnonzero(breaks)
    sizes = np.diff(starts, append=len(raw))
    words = kinds[starts] > 0
    return starts[words], sizes[words]


class PieceEncoder:
    """Encodes texts with a tokenizer that never joins its pieces, so the ids of each piece are kept.

    Texts of ASCII and common Latin letters are cut as the tokenizer's own pattern cuts them, a byte for a letter, and
    their pieces looked up side by side; others go as words at white space, which the tokenizer cuts itself. The
    tokenizer encodes each piece or word that is new.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self.bare = None  # the same model for pieces that are cut, in lower case and in the letters that stand for bytes
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        suffix, vocab = spec["model"].get("end_of_word_suffix"), spec["model"]["vocab"]
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        whole = suffix and all(x in vocab and x + suffix in vocab for x in BYTES)  # so each piece's last id, and no other, has the suffix
        if kinds == NORMALIZERS and split.get("pattern", {}).get("Regex") == PATTERN and whole:
            spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}
            self.bare = Tokenizer.from_str(json.dumps(spec))
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for x, i in vocab.items() if x.endswith(suffix)]] = True
        self.turn = 0
        self.table, self.places, self.known = PieceTable(), {}, 0
        self.starts, self.sizes, self.met = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.pool = np.zeros(1 << 14, np.uint32)
        self.filled = 0

    def _trim(self) -> None:
        """Only pieces met in the later turns stay, about half."""
        n = self.known
        stays = self.met[:n] > np.median(self.met[:n])
        keep, places = np.flatnonzero(stays), np.cumsum(stays) - 1
        sizes = self.sizes[keep]
        ends = np.cumsum(sizes)
        self.pool = self.pool[np.repeat(self.starts[keep] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        self.filled, self.starts, self.sizes, self.met, self.known = len(self.pool), ends - sizes, sizes, self.met[keep], len(keep)
        self.places = {x: int(places[i]) for x, i in self.places.items() if stays[i]}
        self.table = self.table.kept(stays, places)

    def _learn(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keep ids of new pieces; their places."""
        n, m = self.known, len(sizes)
        if n + m > len(self.starts):
            self.starts, self.sizes, self.met = (np.concatenate([x[:n], np.zeros(2 * m + n, np.int64)]) for x in (self.starts, self.sizes, self.met))
        if self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.zeros(2 * len(flat) + self.filled, np.uint32)])
        self.sizes[n : n + m] = sizes
        self.starts[n : n + m] = self.filled + np.cumsum(sizes) - sizes
        self.pool[self.filled : self.filled + len(flat)] = flat
        self.filled, self.known = self.filled + len(flat), n + m
        return np.arange(n, n + m)

    def _words(self, words: list[str], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The places of words by their strings."""
        at = np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys(words[i] for i in missing.tolist()))
            self.places.update(zip(new, self._learn(*encode(new)).tolist(), strict=True))
            at[missing] = [self.places[words[i]] for i in missing.tolist()]
        return at

    def _by_word(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _by_piece(self, pieces: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that stand end to end with a space after each, and each one's number of ids."""
        bounds = [0, *ends[RUN - 1 : -1 : RUN].tolist(), int(ends[-1])]
        runs = [UNUSUAL.sub(lambda x: SPELLED[x[0]], pieces[a:b]) for a, b in pairwise(bounds)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(runs, add_special_tokens=False)])
        return flat, np.diff(np.flatnonzero(self.last[flat]), prepend=-1)

    def _long(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._by_piece("".join(f"{x} " for x in pieces), np.cumsum([len(x) + 1 for x in pieces]))

    def _pieces(self, text: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The places of pieces of a text that has LONG bytes after it."""
        padded = np.frombuffer(text, np.uint8)
        words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # eight bytes from each place
        short = np.minimum(sizes, LONG)
        keys = np.stack([words[starts] & MASKS[0][short], words[starts + 8] & MASKS[1][short] | short.astype(np.uint64) << np.uint64(56)])
        at = self.table.find(keys)
        long = np.flatnonzero(sizes >= LONG)
        if len(long):
            at[long] = self._words([text[a : a + n].decode("latin-1") for a, n in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)], self._long)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            order = missing[np.lexsort(keys[:, missing])]
            heads = np.append(True, (keys[:, order[1:]] != keys[:, order[:-1]]).any(0))
            new = order[heads]
            ends = np.cumsum(sizes[new] + 1)
            laid = padded[np.repeat(starts[new] + sizes[new] + 1 - ends, sizes[new] + 1) + np.arange(int(ends[-1]))]
            laid[ends - 1] = ord(" ")
            numbers = self._learn(*self._by_piece(laid.tobytes().decode("latin-1"), ends))
            self.table.add(keys[:, new], numbers)
            at[order] = numbers[np.cumsum(heads) - 1]
        return at

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each with the end id; and each one's number of ids."""
        self.turn += 1
        if self.known > KEPT_PIECES:
            self._trim()
        plain = np.array([self.bare is not None and not ODD.search(x) and not any(y in x for y in self.special) for x in texts], bool)
        counts = np.zeros(len(texts), np.int64)
        parts = {}
        if plain.any():
            text = "\n".join([x for x, p in zip(texts, plain.tolist(), strict=True) if p]).encode("latin-1").translate(LOWER) + bytes(LONG)
            starts, sizes = cut(np.frombuffer(text, np.uint8, len(text) - LONG))
            ends = np.cumsum([len(x) + 1 for x, p in zip(texts, plain.tolist(), strict=True) if p])
            counts[plain] = np.diff(np.searchsorted(starts, ends), prepend=0)
            parts[True] = np.concatenate([self._pieces(text, starts[i : i + SIDE], sizes[i : i + SIDE]) for i in range(0, max(1, len(starts)), SIDE)])
        if not plain.all():
            lists = [words_of(x) for x, p in zip(texts, plain.tolist(), strict=True) if not p]
            counts[~plain] = [len(x) for x in lists]
            parts[False] = self._words(list(chain.from_iterable(lists)), self._by_word)
        at = np.empty(int(counts.sum()), np.int64)
        of = np.repeat(plain, counts)
        for kind, places in parts.items():
            at[of == kind] = places
        self.met[at] = self.turn
        sizes, starts = self.sizes[at], self.starts[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
        flat = self.pool[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])]
        return np.insert(flat, bounds[1:], self.end_id), np.diff(bounds) + 1


def _groups(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield start, i
            start, size = i, 0
        size += len(x)
    if len(texts) > start:
        yield start, len(texts)


@lru_cache(maxsize=1)
def encoder_of(path: str, end_id: int) -> PieceEncoder:
    """One for each Python worker, so that tasks after the first find its pieces."""
    return PieceEncoder(path, end_id)


def pack(ids: np.ndarray) -> bytes:
    """Ids as compressed byte planes, for the pass between."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def encoded_blocks(docs: DataFrame, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of packed ids in ascending order of document id; a shard is what one task has."""
    spark = docs.sparkSession
    C.small_batches(spark)
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("packed", pa.binary())])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = encoder_of(tokenizer, end_id), TaskContext.get().partitionId()
        start = block = held = 0
        keys, sizes, ids = [], [], []

        def full():
            return C.batch_of(schema, [shard], [block], [start], [held], [keys], [sizes], [pack(np.concatenate(ids))])

        for batch in batches:
            all_keys, texts = C.values(batch, "key"), C.values(batch, "text")
            for a, b in _groups(texts):
                flat, n = encoder(texts[a:b])
                for k, size, end in zip(all_keys[a:b], n.tolist(), np.cumsum(n).tolist(), strict=True):
                    if held and held + size > BLOCK_IDS:
                        yield full()
                        start, block, held = start + held, block + 1, 0
                        keys, sizes, ids = [], [], []
                    keys.append(k)
                    sizes.append(size)
                    ids.append(flat[end - size : end])
                    held += size
        if keys:
            yield full()

    named = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), C.total_bytes(docs, text) // SHARD)
    ordered = named.repartitionByRange(n, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    return ordered.mapInArrow(encoded, "shard int, block int, start long, n_ids long, keys array<long>, sizes array<long>, packed binary")


def id_counts(blocks: DataFrame) -> np.ndarray:
    """How often each id occurs in all blocks. A task sends at most one number per id of the vocabulary."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for packed in C.values(batch, "packed"):
                n = np.bincount(unpack(packed), minlength=len(total))
                n[: len(total)] += total
                total = n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(seen.astype(np.int32)), "n": pa.array(total[seen])})

    table = blocks.select("packed").mapInArrow(counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = np.asarray(table.column("id")), np.asarray(table.column("n"))
    out = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    out[ids] = n
    return out


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> None:
    """Encode all texts into ``folder``: ``blocks`` in ascending order of id, and ``code``."""
    spark = docs.sparkSession
    raw = C.staged(encoded_blocks(docs, tokenizer, end_id, key, text), "token-ids")
    lengths = huffman.code_lengths(id_counts(raw))
    codes = huffman.canonical(lengths)
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").write.parquet(f"{folder}/code")
    names = ["shard", "block", "start", "n_ids", "keys", "sizes"]

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, packed in enumerate(C.values(batch, "packed")):
                bits, checkpoints = huffman.encode(unpack(packed), lengths, codes)
                row = batch.slice(i, 1).select(names)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([bits], pa.binary()), pa.array([checkpoints], pa.binary())], names=[*names, "bits", "checkpoints"])

    raw.mapInArrow(written, "shard int, block int, start long, n_ids long, keys array<long>, sizes array<long>, bits binary, checkpoints binary").write.parquet(f"{folder}/blocks")
    C.unstage(raw)


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32; and the ids themselves if asked for."""
    C.small_batches(spark)
    lengths = np.frombuffer(spark.read.parquet(f"{folder}/code").first()["lengths"], np.uint8)
    codes = huffman.canonical(lengths)
    blocks = spark.read.parquet(f"{folder}/blocks")
    shards = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())  # one row a shard
    before = dict(zip((s for s, _ in shards), np.cumsum([0] + [n for _, n in shards]).tolist(), strict=False))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, width = huffman.decoding_table(lengths, codes)
        for batch in batches:
            for shard, start, n_ids, keys, sizes, bits, checkpoints in zip(*(C.values(batch, x) for x in ("shard", "start", "n_ids", "keys", "sizes", "bits", "checkpoints")), strict=True):
                ids = huffman.decode(bits, checkpoints, n_ids, table, width).astype("<u4")
                ends = np.cumsum(sizes)
                parts = [ids[e - n : e] for e, n in zip(ends.tolist(), sizes, strict=True)]
                out = {"doc_id": pa.array(keys, pa.int64()), "start": pa.array(before[shard] + start + ends - sizes), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64())}
                if with_ids:
                    out["ids"] = pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    return blocks.select("shard", "start", "n_ids", "keys", "sizes", "bits", "checkpoints").mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and return what reads back from them, a row per document.

    Null texts count as empty and have the end id alone. Rows that repeat an id follow each other in order of
    text; null ids come first. A text of any length is one document of one block. Empty tables give no rows.
    """
    spark = docs.sparkSession
    folder = folder or C.scratch(spark, "tokens")
    write(docs, folder, tokenizer or tokenizer_path(), end_id, key, text)
    return read(spark, folder)
