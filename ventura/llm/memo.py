"""A memo of id sequences by string or bytes, for tokenisation inside tasks."""

from __future__ import annotations

from itertools import chain

import numpy as np


class Memo:
    """Id sequences by string or bytes, in one flat pool that doubles."""

    def __init__(self) -> None:
        self.at: dict[str | bytes, int] = {}
        self.start, self.size, self.pool, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1 << 16, np.uint32), 0

    def add(self, keys: list, size: np.ndarray, flat: np.ndarray) -> None:
        n, end = len(self.at), self.used + len(flat)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(end, np.uint32)])
        if n + len(keys) > len(self.size):
            more = np.zeros(n + len(keys), np.int64)
            self.start, self.size = np.concatenate([self.start, more]), np.concatenate([self.size, more])
        self.pool[self.used : end] = flat
        self.size[n : n + len(keys)] = size
        self.start[n : n + len(keys)] = self.used + np.cumsum(size) - size
        self.at.update(zip(keys, range(n, n + len(keys))))
        self.used = end

    def gather(self, rows: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows of known strings, end to end, and where each row ends."""
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        at = np.fromiter(map(self.at.__getitem__, chain.from_iterable(rows)), np.int64, int(counts.sum()))
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[np.cumsum(counts)]


class HashMemo:
    """Id sequences by 64-bit hash, with a second hash as check: sorted keys found by binary search, and one flat pool."""

    def __init__(self) -> None:
        self.keys, self.check, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.start, self.size, self.pool = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def __len__(self) -> int:
        return len(self.keys)

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys aren't known."""
        if not len(self.keys):
            return np.ones(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys

    def add(self, keys: np.ndarray, check: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        """New keys, sorted, their checks, and their ids end to end."""
        at = np.searchsorted(self.keys, keys)
        self.slot = np.insert(self.slot, at, np.arange(len(self.size), len(self.size) + len(keys), dtype=np.int32))
        self.keys, self.check = np.insert(self.keys, at, keys), np.insert(self.check, at, check)
        self.start = np.concatenate([self.start, (len(self.pool) + np.cumsum(size) - size).astype(np.int32)])
        self.size, self.pool = np.concatenate([self.size, size.astype(np.int32)]), np.concatenate([self.pool, flat])

    def gather(self, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the known keys[at], end to end, the number of ids up to each, and each one's check."""
        place = np.searchsorted(self.keys, keys)
        slot = self.slot[place][at]
        size = self.size[slot].astype(np.int64)
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.start[slot] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, ends, self.check[place][at]
