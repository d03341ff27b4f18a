"""Encoding and decoding with a piece model of merges (byte-pair encoding with byte fallback).

The model joins, again and again, the two neighbours whose joint piece has the best score (the leftmost of
equals). Merges on either side of a boundary that stays do not see each other, so every prefix of a text has
one encoding of its own, which ends in one token; and a token may follow another exactly if the two side by side
encode as themselves. So a table over prefixes is filled from left to right: of the pieces that end at a place,
as an automaton finds them, the one that may follow the last token of the prefix before it is this prefix's last
token. The ids are read off backwards from the table. Short prefixes stay in it for the words to come.

Whether two tokens may stand side by side follows from the merges that make each of them: both run on, the better
score first, and no joint piece of the two fragments that touch may come before either's next merge.

No piece of such a model holds a word's end and the space after it, so texts are cut there, and the ids of words
that were met are kept. Where a model has such a piece, texts are not cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .idtools import Decimals, Kept, Strings

SPACE = "▁"
#: Answers about two neighbours that a worker keeps.
KEPT_PAIRS = 1 << 20
#: Prefixes of words that stay in the table from word to word, and their greatest length.
KEPT_PREFIXES, DEPTH = 1 << 20, 12
STATES = (1 << 32) - 1
#: What stands for the unknown token in a decoded text where the model names nothing else, and for a byte that is no UTF-8.
UNKNOWN, NO_TEXT = " ⁇ ", "�"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceModel:
    """Encodes and decodes as the library that made the model does, without begin or end ids and without sampling."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        kinds, norm = proto.ModelProto.SentencePiece, spec.normalizer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or not spec.trainer_spec.byte_fallback or not plain or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError(f"{path} is no model of merges with byte fallback that takes texts as they are")
        self.size = len(spec.pieces)
        self.scores = {p.piece: p.score for p in spec.pieces if p.type == kinds.NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.of_byte = [0] * 256
        strings = []
        self.is_byte, self.is_mark, self.is_unknown = (np.zeros(self.size, bool) for _ in range(3))
        for i, p in enumerate(spec.pieces):
            if p.type == kinds.BYTE:
                self.of_byte[int(p.piece[3:5], 16)] = i
                self.is_byte[i] = True
                strings.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kinds.NORMAL:
                strings.append(p.piece.replace(SPACE, " ").encode())
            else:
                self.is_mark[i], self.is_unknown[i] = p.type == kinds.CONTROL, p.type == kinds.UNKNOWN
                strings.append(b"" if p.type == kinds.CONTROL else (spec.trainer_spec.unk_surface or UNKNOWN).encode())
        self.strings = Strings(strings)
        self.spaced = np.array([p.type == kinds.NORMAL and p.piece.startswith(SPACE) for p in spec.pieces])
        self.steps: dict[str, list[tuple[float, str, str]]] = {}
        self.goto: list[dict[str, int]] | None = None  # the automaton, made when it is first asked for
        self.pieces = [p.piece for p in spec.pieces]
        self.lengths = [len(x) for x in self.pieces]
        self.pairs: dict[int, bool] = {}
        self.table: dict[str, int] = {}  # of each prefix the last token and, in the lower half, the automaton's state after it
        self.unit = None if any(re.search(f"[^{SPACE}]{SPACE}", x) for x in self.scores) else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.kept = Kept(lambda units: [self.tokens(x) for x in units])

    def _prepare(self) -> None:
        for piece in self.scores:
            parts, steps = self.merged(piece)
            if len(parts) == 1:  # others never come out
                self.steps[piece] = steps
        self.goto, self.fail, self.found = automaton({x: self.ids[x] for x in self.steps})

    def merged(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """The parts of ``text`` once nothing joins any more; and of each merge the score, the last and the first part after it."""
        parts, steps = list(text), []
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts, steps
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[-1], parts[0]))

    def side_by_side(self, a: str, b: str) -> bool:
        """Whether ``a`` and then ``b`` encode as themselves: no merge across their boundary comes first at any time."""
        left, right, i, j, x, y = self.steps.get(a, ()), self.steps.get(b, ()), 0, 0, a[-1], b[0]
        while True:
            s = self.scores.get(x + y)
            next_a, next_b = left[i][0] if i < len(left) else None, right[j][0] if j < len(right) else None
            if s is not None and (next_a is None or s > next_a) and (next_b is None or s >= next_b):
                return False
            if next_a is None and next_b is None:
                return True
            if next_b is None or (next_a is not None and next_a >= next_b):
                x, i = left[i][1], i + 1
            else:
                y, j = right[j][2], j + 1

    def _fits(self, before: int, token: int) -> bool:
        """Whether one token may follow another; answers are kept."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        out = self.pairs[before << 24 | token] = self.side_by_side(self.pieces[before] if before < self.size else chr(before - self.size), self.pieces[token])
        return out

    def tokens(self, text: str) -> list[int]:
        """The ids of a text whose spaces are marked already. A character without a piece counts as the token of its code point, from ``size`` on."""
        if self.goto is None:
            self._prepare()
        table, pairs, lengths, size = self.table, self.pairs, self.lengths, self.size
        goto, fail, found = self.goto, self.fail, self.found
        n = len(text)
        known = min(n, DEPTH)
        while known and text[:known] not in table:
            known -= 1
        last: list[int] = []  # from the first prefix on that the table does not have
        state = table[text[:known]] & STATES if known else 0
        for end in range(known, n):
            char = text[end]
            while (to := goto[state].get(char)) is None and state:
                state = fail[state]
            state = to or 0
            for token in found[state]:
                start = end + 1 - lengths[token]
                if not start:
                    break
                before = last[start - known - 1] if start > known else table[text[:start]] >> 32
                fits = pairs.get(before << 24 | token)
                if self._fits(before, token) if fits is None else fits:
                    break
            else:
                token = size + ord(char)
            last.append(token)
            if end < DEPTH:
                table[text[: end + 1]] = token << 32 | state
        out, at = [], n
        while at:
            token = last[at - known - 1] if at > known else table[text[:at]] >> 32
            if token < size:
                out.append(token)
                at -= lengths[token]
            else:
                at -= 1
                out.extend(self.of_byte[x] for x in reversed(text[at].encode()))
        out.reverse()
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and each one's number. An empty text has none."""
        lists = []
        for x in texts:
            marked = SPACE + x.replace(" ", SPACE) if x else ""
            lists.append(self.unit.findall(marked) if self.unit else [marked] * bool(marked))
        if len(self.table) > KEPT_PREFIXES:
            self.table.clear()
        return self.kept(lists)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Texts in UTF-8 of runs of ids; bytes that make no character are replaced, each by itself."""
        data, ends = self.strings.joined(ids)
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        runs = np.concatenate([[0], np.cumsum(counts)]).tolist()
        whole = data.tobytes()
        out = []
        for a, b, i, j in zip(upto[:-1], upto[1:], runs[:-1], runs[1:], strict=True):
            if i == j:
                out.append(b"")
                continue
            text = whole[a + bool(self.spaced[ids[i]]) : b]
            try:
                text.decode()
                odd = self.is_mark[ids[i:j]].any()
            except UnicodeDecodeError:
                odd = True
            out.append(self._decode_odd(ids[i:j]) if odd else text)
        return out

    def through(self, library) -> PieceModel:
        """Takes the ids of new words from the library's processor instead, for users that need no more than the ids."""
        own = self.tokens

        def encode(units: list[str]) -> list[list[int]]:
            found = library.encode([x[1:].replace(SPACE, " ") for x in units], num_threads=1)
            return [y or own(x) for x, y in zip(units, found, strict=True)]  # the library puts a mark before what is not empty

        self.kept.encode = encode
        return self

    def _decode_odd(self, ids: np.ndarray) -> bytes:
        """As ``decode``, for ids that hold marks or bytes that make no characters."""
        out, run, spaced = bytearray(), bytearray(), False
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.strings.pool[self.strings.starts[i] : self.strings.starts[i] + 1].tobytes()
                continue
            out += characters(bytes(run))
            run.clear()
            if i >= 0:
                first = not spaced and not out
                piece = self.strings.pool[self.strings.starts[i] : self.strings.starts[i] + self.strings.sizes[i]].tobytes()
                spaced = spaced or (first and bool(self.spaced[i]))
                out += piece[1:] if first and self.spaced[i] else piece
        return bytes(out)


def automaton(pieces: dict[str, int]) -> tuple[list[dict[str, int]], list[int], list[tuple[int, ...]]]:
    """Of each state: where each character leads, the state of its longest suffix, and the ids of the pieces that end there, the longest first."""
    goto, fail, found = [{}], [0], [()]
    for piece, token in pieces.items():
        s = 0
        for c in piece:
            if c not in goto[s]:
                goto[s][c] = len(goto)
                goto.append({})
                fail.append(0)
                found.append(())
            s = goto[s][c]
        found[s] = (token,)
    level = [(s, 0, c) for c, s in goto[0].items()]
    while level:
        below = []
        for s, above, c in level:
            if above:
                f = fail[above]
                while c not in goto[f] and f:
                    f = fail[f]
                fail[s] = goto[f].get(c, 0)
            found[s] += found[fail[s]]
            below += [(t, s, x) for x, t in goto[s].items()]
        level = below
    return goto, fail, found


def characters(run: bytes) -> bytes:
    """Bytes as UTF-8, those that make no character replaced."""
    out, at = bytearray(), 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                run[at : at + n].decode()
            except UnicodeDecodeError:
                continue
            if at + n <= len(run):
                out += run[at : at + n]
                break
        else:
            n = 1
            out += NO_TEXT.encode()
        at += n
    return bytes(out)


@lru_cache(maxsize=2)
def model_of(path: str) -> PieceModel:
    """One for each Python worker."""
    return PieceModel(path)


@lru_cache(maxsize=1)
def library_model_of(path: str) -> PieceModel:
    """One for each Python worker, that takes new words' ids from the library."""
    from sentencepiece import SentencePieceProcessor

    return PieceModel(path).through(SentencePieceProcessor(model_file=path))


@lru_cache(maxsize=2)
def decimals_of(n: int) -> Decimals:
    return Decimals(n)


def encode(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, ids (array of int). Null and empty texts have none; a text is never cut by its length; equal rows have equal results."""
    C.small_batches(docs.sparkSession)
    model = model or model_path()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for batch in batches:
            for a, b in C.blocks(batch, "text"):
                part = batch.slice(a, b - a)
                ids, n = m.encode(C.values(part, "text"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, model: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row of ``tokens``: doc_id, text of its ids. Null counts as no ids; ids outside the vocabulary are an error."""
    C.small_batches(tokens.sparkSession)
    model = model or model_path()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for batch in batches:
            lists = batch.column(1)
            flat, counts = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            if len(flat) and not 0 <= flat.min() <= flat.max() < m.size:
                raise ValueError("an id is outside the vocabulary")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode() for x in m.decode(flat, counts)], pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids")).mapInArrow(decoded, "doc_id long, text string")


def digests(docs: DataFrame, model: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256 (of the ids in decimal, joined by commas) and decoded_sha256 (of the text that the ids decode to).

    A null text counts as empty: no ids, and both digests are those of nothing. Rows that repeat stay; an
    empty table gives no rows; other columns are not read.
    """
    C.small_batches(docs.sparkSession)
    model = model or model_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for batch in batches:
            for a, b in C.blocks(batch, "text"):
                part = batch.slice(a, b - a)
                ids, n = m.encode(C.values(part, "text"))
                after = np.full(len(ids), ord(","), np.uint8)
                runs = np.concatenate([[0], np.cumsum(n)])
                after[runs[1:][n > 0] - 1] = 0
                written, ends = decimals_of(m.size).joined(ids, after)
                upto = np.concatenate([[0], ends])[runs].tolist()
                shas = [hashlib.sha256(written[i:j]).hexdigest() for i, j in zip(upto[:-1], upto[1:], strict=True)]
                yield C.batch_of(schema, part.column(0), n, shas, [hashlib.sha256(x).hexdigest() for x in m.decode(ids, n)])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(digested, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
