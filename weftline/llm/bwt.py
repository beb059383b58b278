"""The Burrows-Wheeler transform and common prefixes of a collection of strings, built column by column.

Round j knows the transform of all suffixes of at most j symbols. It inserts one symbol of each string, the one before its
suffix of j symbols, where that suffix stands; where the same symbol's suffixes stand next tells, by one stable sort of the
transform, where the suffix that is a symbol longer goes. The common prefix of a new suffix with its neighbours is one more
than the least common prefix between their tails. Each round reads the columns once in order and writes them anew.
"""

from __future__ import annotations

import numpy as np


class _Least:
    """Minima of ranges of a column, from the minima of all runs of 1, 2, 4 ... entries."""

    def __init__(self, column: np.ndarray, longest: int):
        self.runs = [column]
        while 2 << (len(self.runs) - 1) <= longest:
            half, last = 1 << (len(self.runs) - 1), self.runs[-1]
            self.runs.append(np.minimum(last[:-half], last[half:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.empty(len(first), self.runs[0].dtype)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k in range(len(self.runs)):
            at = np.flatnonzero(level == k)
            if len(at):
                out[at] = np.minimum(self.runs[k][first[at]], self.runs[k][last[at] - (1 << k) + 1])
        return out


def transform(symbols: np.ndarray, starts: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all suffixes of some strings in order: the symbol before each (0 at a string's start), the string, the suffix's
    length, and its common prefix with the one before, at most cap. Ends of strings count as different.

    symbols holds the strings one after the other, each symbol over 0; starts where each starts, and the end.
    """
    size = np.diff(starts)
    m, rounds, ends = len(size), int(size.max(initial=0)), starts[1:]
    kind = np.uint8 if symbols.max(initial=0) < 256 else np.uint16 if symbols.max() < 65536 else np.uint32  # the first two are sorted by radix
    columns = np.zeros((rounds + 1, m), kind)  # row j: the symbol before each suffix of j symbols
    for j in range(rounds):
        live = size > j
        columns[j, live] = symbols[ends[live] - 1 - j]
    before, lcp, at = columns[0].copy(), np.zeros(m, np.uint8 if cap < 255 else np.int32), np.arange(m)
    for j in range(rounds):
        active = np.flatnonzero(size > j)
        order = np.argsort(before, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        done = len(before) - int(np.count_nonzero(before))
        here = at[active]
        r, own = place[here], before[here]
        prior, after = order[r - 1], order[np.minimum(r + 1, len(order) - 1)]
        has_prior = (r > 0) & (before[prior] == own)
        has_after = (r + 1 < len(order)) & (before[after] == own)
        a, b = here[has_prior], here[has_after]
        prior, after = prior[has_prior], after[has_after]
        least = _Least(lcp, max(int((a - prior).max(initial=1)), int((after - b).max(initial=1))))
        prefix = np.zeros(len(active), lcp.dtype)
        prefix[has_prior] = np.minimum(least.of(prior + 1, a), cap - 1) + 1
        follow = np.minimum(least.of(b + 1, after), cap - 1) + 1
        to = m + r - done
        old = np.ones(len(before) + len(active), bool)
        old[to] = False
        before, lcp = _put(before, old, to, columns[j + 1, active]), _put(lcp, old, to, prefix)
        lcp[to[has_after] + 1] = follow
        at[active] = to
    return before, *_owners(before, size, m), lcp


def _put(column: np.ndarray, old: np.ndarray, to: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty(len(old), column.dtype)
    out[old] = column
    out[to] = values
    return out


def _owners(before: np.ndarray, size: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """String and length of every suffix: each string is walked from its end through the finished transform."""
    order = np.argsort(before, kind="stable")
    done = len(before) - int(np.count_nonzero(before))
    after = np.empty(len(before), np.int64)
    after[order] = np.arange(m - done, m - done + len(order))
    owner, length = np.empty(len(before), np.int32), np.empty(len(before), np.int32)
    who, at = np.arange(m), np.arange(m)
    for j in range(int(size.max(initial=0)) + 1):
        owner[at], length[at] = who, j
        go = size[who] > j
        who, at = who[go], after[at[go]]
    return owner, length


def of_bytes(strings: list[bytes], cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """transform() with a symbol for each byte."""
    return transform(np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1, np.concatenate([[0], np.cumsum([len(x) for x in strings])]).astype(np.int64), cap)


def grams(strings: list[bytes], width: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings in symbols of width bytes: for each string and phase (offset under width) of `least` symbols and more, its symbols.

    Symbols, starts, and the string and the phase of each. Equal runs of width * k bytes are equal runs of k symbols of one phase each.
    """
    flat = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint64)
    size = np.array([len(x) for x in strings])
    first = np.cumsum(size) - size
    count = (size[:, None] - np.arange(width)) // width
    who, phase = np.nonzero(count >= least)
    n = count[who, phase]
    starts = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    at = np.repeat(first[who] + phase - starts[:-1] * width, n) + np.arange(starts[-1]) * width
    words = np.zeros(len(at), np.uint64)
    for k in range(width):
        words = words << np.uint64(8) | flat[at + k]
    _, codes = np.unique(words, return_inverse=True)
    return codes.astype(np.int64) + 1, starts, who, phase
