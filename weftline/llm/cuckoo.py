"""A cuckoo filter in numpy: four 16-bit cells a bucket, two buckets a key, insertions, lookups and deletions in bulk."""

from __future__ import annotations

import numpy as np

CELLS, KICKS = 4, 500
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Full(Exception):
    """No cell is left for a key; the owner builds a larger filter from its exact table."""


class Cuckoo:
    def __init__(self, capacity: int, cells: np.ndarray | None = None):
        self.buckets = 1 << max(4, int(capacity / (CELLS * 0.8)).bit_length())
        if cells is not None:
            self.buckets = len(cells) // CELLS
        self.cells = (np.zeros(self.buckets * CELLS, np.uint16) if cells is None else cells.copy()).reshape(-1, CELLS)
        self.mask = self.buckets - 1

    @property
    def capacity(self) -> int:
        return int(self.buckets * CELLS * 0.8)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints (never 0) and both buckets of 64-bit keys."""
        h = keys.astype(np.uint64) * _A
        mark = ((h >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        one = ((h >> np.uint64(8)) & np.uint64(self.mask)).astype(np.int64)
        return mark, one, one ^ self.other(mark)

    def other(self, mark):
        return (((mark.astype(np.uint64) * _B) >> np.uint64(20)) & np.uint64(self.mask)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys that are not in."""
        mark, one, two = self.places(keys)
        return (self.cells[one] == mark[:, None]).any(axis=1) | (self.cells[two] == mark[:, None]).any(axis=1)

    def insert(self, keys: np.ndarray) -> None:
        """Adds each key once more; raises Full where that fails."""
        mark, one, two = self.places(keys)
        left = np.arange(len(keys))
        for bucket in (one, two):
            while len(left):
                free = self.cells[bucket[left]] == 0
                open_ = free.any(axis=1)
                where, first = np.unique(bucket[left[open_]], return_index=True)
                if not len(where):
                    break
                put = left[open_][first]
                self.cells[where, free[open_][first].argmax(axis=1)] = mark[put]
                left = np.setdiff1d(left, put, assume_unique=True)
        rng = np.random.default_rng(1)
        for k in left:
            self._kick(mark[k], int(one[k]), rng)

    def _kick(self, mark: np.uint16, at: int, rng: np.random.Generator) -> None:
        for _ in range(KICKS):
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = mark
                return
            cell = int(rng.integers(CELLS))
            mark, self.cells[at, cell] = self.cells[at, cell], mark
            at = int(at ^ self.other(np.array([mark], np.uint16))[0])
        raise Full

    def delete(self, keys: np.ndarray) -> None:
        """Takes each key (which must be in) out once."""
        mark, one, two = self.places(keys)
        for m, a, b in zip(mark, one, two, strict=True):
            for at in (a, b):
                hit = np.flatnonzero(self.cells[at] == m)
                if len(hit):
                    self.cells[at, hit[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.cells.tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> Cuckoo:
        return Cuckoo(0, np.frombuffer(data, np.uint16))
