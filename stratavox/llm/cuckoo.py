"""Cuckoo filters in numpy: approximate sets of 64-bit keys with insertion and deletion."""

from __future__ import annotations

import numpy as np

SLOTS = 4


class CuckooFilter:
    """Buckets of four 16-bit fingerprints. No false negatives for keys that were inserted once and not deleted."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.75)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of distinct keys; where they don't fit, one of twice the size."""
        made = cls.sized(len(keys))
        while not made.insert(keys):
            made = cls(np.zeros((2 * len(made.table), SLOTS), np.uint16))
        return made

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return (bucket ^ (mark.astype(np.int64) * 0x5BD1E995)) & (len(self.table) - 1)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        mark = (x & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (x >> np.uint64(16)).astype(np.int64) & (len(self.table) - 1)
        return mark, first, self._other(first, mark)

    def insert(self, keys: np.ndarray, kicks: int = 400) -> bool:
        """Adds all keys at once, round by round; False if some found no place."""
        mark, bucket, _ = self._places(keys)
        rng = np.random.default_rng(len(keys))
        for turn in range(kicks):
            order = np.argsort(bucket, kind="stable")
            mark, bucket = mark[order], bucket[order]
            first = np.searchsorted(bucket, bucket)
            rank = np.arange(len(bucket)) - first
            free = self.table[bucket] == 0
            fits = rank < free.sum(1)
            at = np.argsort(~free[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
            self.table[bucket[fits], at] = mark[fits]
            mark, bucket = mark[~fits], bucket[~fits]
            if not len(mark):
                return True
            if turn:  # one key a bucket takes the place of another, which goes on
                lead = np.r_[True, bucket[1:] != bucket[:-1]]
                slot = rng.integers(0, SLOTS, int(lead.sum()))
                out = self.table[bucket[lead], slot]
                self.table[bucket[lead], slot] = mark[lead]
                mark[lead] = out
            bucket = self._other(bucket, mark)
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(keys)
        return ((self.table[a] == mark[:, None]) | (self.table[b] == mark[:, None])).any(1)

    def delete(self, keys: np.ndarray) -> None:
        """Takes out one fingerprint of each key, which must be in the filter."""
        for m, a, b in zip(*self._places(keys), strict=True):
            for bucket in (a, b):
                hit = np.flatnonzero(self.table[bucket] == m)
                if len(hit):
                    self.table[bucket, hit[0]] = 0
                    break
