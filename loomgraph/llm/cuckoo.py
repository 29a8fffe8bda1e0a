"""A cuckoo filter on numpy arrays: batched lookups, insertions and deletions of 64-bit keys."""

from __future__ import annotations

import struct

import numpy as np

SLOTS, MAX_LOAD, MAX_KICKS = 4, 0.85, 500
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


class CuckooFilter:
    """Buckets of four 32-bit fingerprints, 0 for a free slot. It answers "surely absent" or "perhaps present".

    It holds each key once: insert() says which keys it may have held before, and those are left to the exact counts
    behind it. A key may be deleted only if it was inserted.
    """

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1
        while buckets * SLOTS * MAX_LOAD < max(capacity, 1):
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint32) if table is None else table
        self.used = int(np.count_nonzero(self.table))

    @property
    def mask(self) -> np.uint64:
        return np.uint64(len(self.table) - 1)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys)
        prints = (h >> np.uint64(32)).astype(np.uint32)
        prints[prints == 0] = 1
        first = (h & self.mask).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return ((bucket.astype(np.uint64) ^ mix(prints)) & self.mask).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        want = prints[:, None]
        return (self.table[first] == want).any(axis=1) | (self.table[second] == want).any(axis=1)

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Adds keys (no two alike); returns which of them the filter may have held, those are not added again.

        Two new keys of one call with the same fingerprint and buckets count as held from the second on.
        """
        held = self.contains(keys)
        prints, first, second = self._places(keys)
        low = np.minimum(first, second)
        order = np.lexsort((prints, low))
        twin = np.zeros(len(keys), dtype=bool)
        twin[order[1:]] = (prints[order][1:] == prints[order][:-1]) & (low[order][1:] == low[order][:-1])
        held |= twin
        new = np.flatnonzero(~held)
        if self.used + len(new) > MAX_LOAD * self.table.size:
            raise OverflowError("the filter is full; rebuild it with a larger capacity from the exact counts")
        self._place(prints[new], first[new])
        return held

    def add(self, keys: np.ndarray) -> None:
        """Adds keys (no two alike) whether or not the filter may hold them."""
        prints, first, _ = self._places(keys)
        self._place(prints, first)

    def room(self) -> int:
        """How many more keys fit."""
        return int(MAX_LOAD * self.table.size) - self.used

    def _place(self, prints: np.ndarray, bucket: np.ndarray) -> None:
        """Rounds: in each, one print per bucket takes a free slot there or in its other bucket, else throws one out."""
        rng = np.random.default_rng(len(prints))
        self.used += len(prints)
        kicks = 0
        while len(prints):
            for _ in range(2):
                # the k-th waiting print of a bucket takes its k-th free slot
                order = np.argsort(bucket, kind="stable")
                prints, bucket = prints[order], bucket[order]
                begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                rank = np.arange(len(bucket)) - np.repeat(begin, np.diff(np.append(begin, len(bucket))))
                free = self.table[bucket] == 0
                nth = np.cumsum(free, axis=1)
                fits = rank < nth[:, -1]
                slot = np.argmax(free & (nth == (rank + 1)[:, None]), axis=1)
                self.table[bucket[fits], slot[fits]] = prints[fits]
                prints, bucket = prints[~fits], bucket[~fits]
                if not len(prints):
                    return
                bucket = self._other(bucket, prints)
            kicks += 1
            if kicks > MAX_KICKS:
                raise OverflowError("the filter is too full; rebuild it with a larger capacity from the exact counts")
            # one waiting print for each bucket changes places with a random tenant
            _, one = np.unique(bucket, return_index=True)
            slot = rng.integers(0, SLOTS, len(one))
            out = self.table[bucket[one], slot]
            self.table[bucket[one], slot] = prints[one]
            prints[one] = out
            bucket[one] = self._other(bucket[one], out)

    def delete(self, keys: np.ndarray) -> None:
        """Removes keys (no two alike) that were inserted."""
        prints, first, second = self._places(keys)
        todo = np.arange(len(keys))
        while len(todo):
            _, one = np.unique(np.minimum(first[todo], second[todo]), return_index=True)  # a pair of buckets changes once a round
            now = todo[one]
            done = np.zeros(len(now), dtype=bool)
            for bucket in (first[now], second[now]):
                hit = (self.table[bucket] == prints[now][:, None]) & ~done[:, None]
                has = hit.any(axis=1)
                self.table[bucket[has], np.argmax(hit, axis=1)[has]] = 0
                self.used -= int(has.sum())
                done |= has
            todo = np.delete(todo, one)

    def to_bytes(self) -> bytes:
        return struct.pack("<q", len(self.table)) + self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        (n,) = struct.unpack_from("<q", raw)
        return cls(0, np.frombuffer(raw, dtype=np.uint32, offset=8).reshape(n, SLOTS).copy())
