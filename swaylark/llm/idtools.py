"""Helpers for runs of token ids: ids of pieces that were met before, and ids in decimal."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np


class Kept:
    """The ids of strings that a worker has met, end to end in one array, with the string's place as its key.

    ``encode`` gives the ids of strings that are new. Beyond ``most`` strings or ids all are forgotten, between
    two calls, so results never depend on what is kept.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 200_000, most_ids: int = 1 << 22):
        self.encode, self.most, self.most_ids = encode, most, most_ids
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.starts, self.sizes, self.filled = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self.pool = np.zeros(1 << 14, np.int32)

    def _learn(self, new: list[str]) -> None:
        found = self.encode(new)
        n, m = len(self.places), len(new)
        if n + m > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x[:n], np.zeros(2 * m + n, np.int64)]) for x in (self.starts, self.sizes))
        sizes = np.fromiter(map(len, found), np.int64, m)
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        if self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.zeros(2 * len(flat) + self.filled, np.int32)])
        self.places.update(zip(new, range(n, n + m), strict=True))
        self.sizes[n : n + m] = sizes
        self.starts[n : n + m] = self.filled + np.cumsum(sizes) - sizes
        self.pool[self.filled : self.filled + len(flat)] = flat
        self.filled += len(flat)

    def __call__(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all lists of strings end to end, and the number of each list."""
        if len(self.places) > self.most or self.filled > self.most_ids:
            self.forget()
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(counts.sum())
        at = np.fromiter(map(self.places.get, chain.from_iterable(lists), repeat(-1)), np.int64, total)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            flat = list(chain.from_iterable(lists))
            new = [flat[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(new)))
            at[missing] = np.fromiter(map(self.places.__getitem__, new), np.int64, len(new))
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.starts[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


class Strings:
    """Byte strings by id, to be laid end to end."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of ``ids`` end to end, and where each ends."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)], ends


class Decimals:
    """Ids below ``n`` in decimal, each with a byte after it."""

    def __init__(self, n: int):
        width = len(str(max(n - 1, 0)))
        digits = np.array([f"{i:{width}d}" for i in range(n)], f"S{width}")
        self.table = np.zeros((n, width + 1), np.uint8)
        self.table[:, :width] = digits.view(np.uint8).reshape(n, width)
        self.mask = np.zeros((n, width + 1), bool)
        self.mask[:, :width] = self.table[:, :width] != ord(" ")

    def joined(self, ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids in decimal, each followed by its byte of ``after`` unless that is 0; and where each ends, that byte included."""
        rows, mask = self.table[ids], self.mask[ids]
        rows[:, -1] = after
        mask[:, -1] = after != 0
        return rows[mask], np.cumsum(mask.sum(1, dtype=np.int64))
