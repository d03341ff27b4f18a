"""Canonical length-limited Huffman codes over token ids, in numpy.

A block's ids are written as one bit string. Every ``STRIDE`` ids a checkpoint keeps the bit offset, so that
decoding walks all stretches between checkpoints at once, one table lookup for each id.
"""

from __future__ import annotations

import numpy as np

#: Bits of the longest code; the decoding table has 2 to this power entries.
LONGEST = 20
STRIDE = 64


def code_lengths(counts: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Code lengths of least total size with none over ``longest`` (package-merge; LONGEST, or what more ids need, if it is not given); 0 for ids that do not occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    longest = longest or max(LONGEST, int(len(used)).bit_length() + 1)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError("too many ids for the longest code")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, row, leaf = [], leaves, np.ones(len(leaves), bool)
    for _ in range(longest):
        levels.append(leaf)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        row, leaf = np.concatenate([leaves, pairs]), np.concatenate([np.ones(len(leaves), bool), np.zeros(len(pairs), bool)])
        by = np.argsort(row, kind="stable")
        row, leaf = row[by], leaf[by]
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for leaf in reversed(levels):  # of each level's cheapest items, the leaves grow by a bit; the others are pairs of the level below
        own = int(leaf[:take].sum())
        depth[:own] += 1
        take = 2 * (take - own)
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then by id."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    code = last = 0
    for n in np.unique(lengths[order]).tolist():
        at = order[lengths[order] == n]
        code <<= n - last
        codes[at] = code + np.arange(len(at), dtype=np.uint32)
        code, last = code + len(at), n
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """The block's bits, and its checkpoints as little-endian 64-bit offsets."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    if not len(ids):
        return b"", b""
    word, shift = starts >> 5, (64 - n - (starts & 31)).astype(np.uint64)
    laid = codes[ids].astype(np.uint64) << shift  # in 64 bits from the start of a 32-bit word
    out = np.zeros(int(ends[-1] >> 5) + 2, np.uint64)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.add.reduceat(laid, heads)  # bits do not overlap
    at = word[heads]
    out[at] += sums >> np.uint64(32)
    out[at + 1] += sums & np.uint64(0xFFFFFFFF)
    return out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], starts[::STRIDE].astype("<i8").tobytes()


def decoding_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, int]:
    """For each string of as many bits as the longest code: id * 32 + the length of its first code; and those bits."""
    width = max(1, int(lengths.max(initial=1)))
    table = np.zeros(1 << width, np.uint32)
    for i in np.flatnonzero(lengths).tolist():
        n = int(lengths[i])
        first = int(codes[i]) << (width - n)
        table[first : first + (1 << (width - n))] = i << 5 | n
    return table, width


def decode(bits: bytes, checkpoints: bytes, count: int, table: np.ndarray, width: int) -> np.ndarray:
    """The block's ``count`` ids."""
    offsets = np.frombuffer(checkpoints, "<i8").copy()
    out = np.zeros((STRIDE, len(offsets)), np.uint32)
    raw = np.concatenate([np.frombuffer(bits, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint32)
    words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # 32 bits from each byte
    last = len(words) - 1
    for j in range(STRIDE):
        seen = words[np.minimum(offsets >> 3, last)] << (offsets & 7).astype(np.uint32) >> np.uint32(32 - width)
        got = table[seen]
        out[j] = got >> np.uint32(5)
        offsets += got & np.uint32(31)
    return out.T.ravel()[:count]
