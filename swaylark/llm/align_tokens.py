"""Which tokens of two tokenizers cover each other.

Both encode the same bytes, a space and the text. Texts of an Arrow batch are laid end to end, part by part, so that
a token's end is one byte offset in the part; ends of A and of B are counted by offset (a bincount each), and
where both occur is a cut between groups. Prefix sums of the counts say which group a token is in and which
tokens meet between two neighbouring ends, and differences at the documents' ends give each document's part.

Two tokens are linked where their bytes overlap. How many documents hold a pair of ids linked is summed over all
documents: blocks of batches hand on their distinct pairs, and ask for the sums of just those, so what is
shuffled is a row for each block and pair, and no pair's rows meet in one task but as sums.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from . import pieces
from .idtools import Kept, Strings
from .tokens import pack, tokenizer_path, unpack

#: Bytes of text in a block, but for a single longer text.
BLOCK = 4 << 20
#: Bytes of text that are laid end to end, as a worker's memory grows with them, and offsets that are counted at once.
PART = 1 << 19
SPAN = 1 << 20
#: Characters that may be white space to some table of characters but not to all, and these with those that are to all.
HALF = "\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿"
BLANK = "\t\n\r " + HALF
WORD = re.compile(f"[{BLANK}]*[^{BLANK}]+(?:[{HALF}][{BLANK}]*[^{BLANK}]*)*|[{BLANK}]+")
#: Bits of B's id in a pair.
CODE_BITS = 32
#: Characters whose kind (letter, number, white space) is the same in every table of characters; and how words are cut into pieces. Fixed value: the pattern of byte-level tokenizers.
PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteModel:
    """Encodes with a byte-level tokenizer; strings of special tokens are plain text. The ids of words that were met are kept.

    A run of white space always starts a token of its own (of which the last space may join the word after it),
    so texts are cut before each run that is white space to every table of characters.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are parallel already
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
            raise ValueError(f"{path} is no byte-level tokenizer that takes texts as they are")
        bytes_of = {c: b for b, c in byte_characters().items()}
        by_id = {i: x for x, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec.get("added_tokens", [])}
        self.size = max(by_id) + 1
        self.strings = Strings([bytes(bytes_of.get(c, 0) for c in by_id.get(i, "")) for i in range(self.size)])
        self.cut = bool(before.get("use_regex"))
        plain = self._ranked(spec) if self.cut else None

        def encode(words: list[str]) -> list[list[int]]:
            odd = [x for x in words if plain is None or not PLAIN.fullmatch(x)]
            found = dict(zip(odd, (e.ids for e in tokenizer.encode_batch_fast(odd, add_special_tokens=False)), strict=True))
            return [found[x] if x in found else plain.encode_ordinary(x) for x in words]

        self.kept = Kept(encode)

    def _ranked(self, spec: dict):
        """An encoder of plain words by the same vocabulary, which is quicker to call; None unless each merge is the next id, so that merges come in the order of ids."""
        import tiktoken

        vocab, merges = spec["model"]["vocab"], [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        base = len(vocab) - len(merges) - sum(x["id"] in vocab.values() for x in spec.get("added_tokens", []))
        if spec["model"].get("ignore_merges") or [vocab.get("".join(x)) for x in merges] != list(range(base, base + len(merges))):
            return None
        added = {x["id"] for x in spec.get("added_tokens", [])}
        tokens = {self.strings.pool[a : a + n].tobytes(): i for i, (a, n) in enumerate(zip(self.strings.starts.tolist(), self.strings.sizes.tolist(), strict=True)) if i not in added}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=tokens, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.kept([WORD.findall(x) if self.cut else [x] for x in texts])


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is visible in Latin-1, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def byte_model_of(path: str) -> ByteModel:
    """One for each Python worker."""
    return ByteModel(path)


class Aligned:
    """Documents end to end in two encodings of the same bytes: the group of each token and the links, in order.

    a, b: the ids of all documents end to end; n_a, n_b: each document's number; ends_a, ends_b: the offset after
    each token. links: for each stretch between two neighbouring ends the index of the token of A and of B that
    covers it; two tokens overlap in one stretch exactly, so each link is there once.
    """

    def __init__(self, a: np.ndarray, n_a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, ends_b: np.ndarray):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        total = int(ends_a[-1]) if len(ends_a) else 0
        groups_a, groups_b, link_a, link_b = [], [], [], []
        seen = seen_a = seen_b = 0
        for base in range(0, total, SPAN):
            size = min(SPAN, total - base)
            i, j = np.searchsorted(ends_a, (base + 1, base + size + 1)), np.searchsorted(ends_b, (base + 1, base + size + 1))
            at_a, at_b = ends_a[i[0] : i[1]] - base - 1, ends_b[j[0] : j[1]] - base - 1
            here_a, here_b = np.bincount(at_a, minlength=size), np.bincount(at_b, minlength=size)
            cuts = here_a & here_b
            before = np.cumsum(cuts) - cuts + seen
            groups_a.append(before[at_a])
            groups_b.append(before[at_b])
            stretch = np.flatnonzero(here_a | here_b)
            link_a.append((np.cumsum(here_a) - here_a)[stretch] + seen_a)
            link_b.append((np.cumsum(here_b) - here_b)[stretch] + seen_b)
            seen, seen_a, seen_b = seen + int(cuts.sum()), seen_a + len(at_a), seen_b + len(at_b)
        none = [np.zeros(0, np.int64)]
        self.groups_a, self.groups_b, self.link_a, self.link_b = (np.concatenate(x or none) for x in (groups_a, groups_b, link_a, link_b))
        self.upto_a, self.upto_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        self.upto_groups = np.concatenate([self.groups_a, [seen]])[self.upto_a]
        self.upto_links = np.searchsorted(self.link_a, self.upto_a)
        self.codes = a[self.link_a].astype(np.int64) << CODE_BITS | b[self.link_b]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of ids that are linked, and how many documents hold each."""
        place, codes = pd.factorize(self.codes)
        doc = np.repeat(np.arange(len(self.n_a)), np.diff(self.upto_links))
        return codes, np.bincount(pd.unique(doc * max(len(codes), 1) + place) % max(len(codes), 1), minlength=len(codes))

    def written(self, width_a, width_b) -> tuple[np.ndarray, np.ndarray]:
        """Each document's groups as text, end to end, and where each document's ends."""
        n = len(self.a) + len(self.b)
        place_a = np.arange(len(self.a)) + np.searchsorted(self.groups_b, self.groups_a)
        place_b = np.arange(len(self.b)) + np.searchsorted(self.groups_a, self.groups_b, "right")
        after_a, after_b = np.full(len(self.a), ord(","), np.uint8), np.full(len(self.b), ord(","), np.uint8)
        after_a[np.append(self.groups_a[1:] != self.groups_a[:-1], True)[: len(self.a)]] = ord("|")
        after_b[np.append(self.groups_b[1:] != self.groups_b[:-1], True)[: len(self.b)]] = ord(";")
        after_b[self.upto_b[1:][self.n_b > 0] - 1] = 0
        ids, after = np.empty(n, np.int64), np.empty(n, np.uint8)
        ids[place_a], ids[place_b], after[place_a], after[place_b] = self.a, self.b, after_a, after_b
        text, ends = pieces.decimals_of(max(width_a, width_b)).joined(ids, after)
        return text, np.concatenate([[0], ends])[self.upto_a + self.upto_b]


def _same_bytes(texts: list[str], a, b) -> np.ndarray:
    """Whether the joined bytes of both encodings are a space and the text."""
    whole = [b" " + x.encode() for x in texts]
    sizes = np.fromiter(map(len, whole), np.int64, len(whole))
    out = sizes > 1
    data = np.frombuffer(b"".join(whole), np.uint8)
    upto = np.cumsum(sizes)
    for strings, ids, n in (a, b):
        joined, ends = strings.joined(ids)
        last = np.concatenate([[0], ends])[np.cumsum(n)]
        if len(joined) == len(data) and (last == upto).all() and (joined == data).all():
            continue
        text, first = joined.tobytes(), np.concatenate([[0], last[:-1]])
        out &= np.array([text[i:j] == x for i, j, x in zip(first.tolist(), last.tolist(), whole, strict=True)], bool)
    return out


def _encoded(texts: list[str | None], first: ByteModel, second: pieces.PieceModel):
    """The ids of both and each text's numbers, none for texts that have no tokens."""
    texts = [x or "" for x in texts]
    a, n_a = first.encode([" " + x for x in texts])
    b, n_b = second.encode(texts)
    good = _same_bytes(texts, (first.strings, a, n_a), (second.strings, b, n_b))
    a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
    return a, n_a * good, b, n_b * good


def _aligned(a, n_a, b, n_b, first: ByteModel, second: pieces.PieceModel) -> Aligned:
    return Aligned(a, n_a, np.cumsum(first.strings.sizes[a]), b, n_b, np.cumsum(second.strings.sizes[b]))


def encoded_blocks(docs: DataFrame, tokenizer: str, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of documents: block, keys, packed ids and numbers of both encodings by Arrow batch, the block's distinct pairs and how many documents hold each."""
    C.small_batches(docs.sparkSession)
    lists = pa.list_(pa.int64())
    schema = pa.schema([("block", pa.int64()), ("keys", lists), ("n_a", lists), ("n_b", lists), ("parts", lists), ("a", pa.binary()), ("b", pa.binary()), ("pairs", lists), ("held", lists)])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, task = byte_model_of(tokenizer), pieces.library_model_of(model), TaskContext.get().partitionId()
        count, size, held = 0, 0, []

        def block():
            keys, a, n_a, b, n_b, codes, n = zip(*held, strict=True)
            pairs, place = np.unique(np.concatenate(codes), return_inverse=True)
            many = np.bincount(place, np.concatenate(n), len(pairs)).astype(np.int64)
            join = np.concatenate
            return C.batch_of(schema, [task << 32 | count], [sum(keys, [])], [join(n_a)], [join(n_b)], [[len(x) for x in keys]], [pack(join(a))], [pack(join(b))], [pairs], [many])

        for batch in batches:
            for i, j in C.blocks(batch, "text", PART):
                part = batch.slice(i, j - i)
                found = _encoded(C.values(part, "text"), first, second)
                held.append((C.values(part, "key"), *found, *_aligned(*found, first, second).pairs()))
                size += part.column(1).nbytes
                if size >= BLOCK:
                    yield block()
                    count, size, held = count + 1, 0, []
        if held:
            yield block()

    named = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return named.mapInArrow(encoded, "block long, keys array<long>, n_a array<long>, n_b array<long>, parts array<long>, a binary, b binary, pairs array<long>, held array<long>")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """Per pair of ids: pair (A's id in the upper half), n (documents that hold it linked), best (whether that is the highest of its id of A)."""
    held = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n"))
    of_a = W.partitionBy(F.shiftright("pair", CODE_BITS))  # as many rows at most as B has ids
    return held.withColumn("best", F.col("n") == F.max("n").over(of_a))


def aligned_groups(docs: DataFrame, tokenizer: str | None = None, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b (tokens of the byte-level and of the piece tokenizer), n_groups, n_links,
    n_best (links whose pair is held by as many documents as any of its id of A), count_sum (of those numbers over
    all links), groups_sha256 (of the groups of ids as text).

    Null and empty texts, and those whose tokens' bytes are not a space and the text (they hold the mark that
    stands for a space), have no tokens: zeros and an empty digest. Rows that repeat an id count as documents of
    their own. Other columns are not read; an empty table gives no rows. A document of any length is in one block.
    """
    tokenizer, model = tokenizer or tokenizer_path("byte_bpe_50k.json"), model or pieces.model_path()
    blocks = C.staged(encoded_blocks(docs, tokenizer, model, key, text), "aligned-tokens")
    asked = blocks.select(F.col("block").alias("of"), F.explode("pairs").alias("pair"))
    told = asked.hint("merge").join(pair_counts(blocks), "pair").select("of", "pair", "n", "best")
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())])

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        first, second = byte_model_of(tokenizer), pieces.library_model_of(model)
        first.kept.forget()  # nothing is encoded any more
        second.kept.forget()
        codes, n, best = (right.column(x).combine_chunks().to_numpy(zero_copy_only=False) for x in ("pair", "n", "best"))
        order = np.argsort(codes)
        codes, n, best = codes[order], n[order], best[order]
        out = []
        for row in left.to_pylist():
            a, b, n_a, n_b = unpack(row["a"]), unpack(row["b"]), np.array(row["n_a"], np.int64), np.array(row["n_b"], np.int64)
            upto = np.concatenate([[0], np.cumsum(row["parts"])]).astype(np.int64)
            upto_a, upto_b = np.concatenate([[0], np.cumsum(n_a)])[upto], np.concatenate([[0], np.cumsum(n_b)])[upto]
            for k, (i, j) in enumerate(pairwise(upto.tolist())):
                part = _aligned(a[upto_a[k] : upto_a[k + 1]], n_a[i:j], b[upto_b[k] : upto_b[k + 1]], n_b[i:j], first, second)
                at = np.searchsorted(codes, part.codes)
                sums = [np.concatenate([[0], np.cumsum(x[at].astype(np.int64))])[part.upto_links] for x in (best, n)]
                written, ends = part.written(first.size, second.size)
                shas = [hashlib.sha256(written[x:y]).hexdigest() if y > x else "" for x, y in pairwise(ends.tolist())]
                out.append(C.batch_of(schema, row["keys"][i:j], n_a[i:j], n_b[i:j], np.diff(part.upto_groups), np.diff(part.upto_links), np.diff(sums[0]), np.diff(sums[1]), shas))
        return pa.Table.from_batches(out, schema)

    sides = blocks.select("block", "keys", "n_a", "n_b", "parts", "a", "b").groupBy("block").cogroup(told.groupBy("of"))
    return sides.applyInArrow(counted, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
