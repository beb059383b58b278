"""Similarity of texts by longest matching blocks, for a batch of pairs at once.

Two texts' blocks are their longest common substring (of equal ones the first in the first text, then in the second), and the
blocks of what is left and right of it; the similarity is 200 times the blocks' letters over the letters of both. All pairs of
a batch advance together: a round looks for one block in each stretch that is still open, with a row of the table of common
suffixes for every letter, over stretches of about one size in one numpy array; what lies beside the blocks is the next round.
Letters that are frequent in a second text of FREQUENT letters or more begin no block, but blocks grow over them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters from which on a text's frequent ones (more than a hundredth of it, and one) begin no block.
FREQUENT = 200
#: Cells of a table at a time.
CELLS, BINS = 1 << 20, 64


def _row(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts, and where each begins (and the end)."""
    first = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), first


def _frequent(b: np.ndarray, first: np.ndarray) -> np.ndarray | None:
    """Places of b whose letter is frequent in its text; none where all texts are short."""
    out = None
    for k in np.flatnonzero(np.diff(first) >= FREQUENT):
        text = b[first[k] : first[k + 1]]
        _, which, n = np.unique(text, return_inverse=True, return_counts=True)
        out = np.zeros(len(b), bool) if out is None else out
        out[first[k] : first[k + 1]] = (n > len(text) // 100 + 1)[which]
    return out


def _longest(a: np.ndarray, b: np.ndarray, frequent: np.ndarray | None, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest block of each stretch (first and end in a, first and end in b): its size, and where it begins in a and b."""
    wide = int((open_[:, 3] - open_[:, 2]).max())
    high = int((open_[:, 1] - open_[:, 0]).max())
    col = np.arange(wide)
    at = open_[:, 2, None] + col
    inside = at < open_[:, 3, None]
    at = np.where(inside, at, open_[:, 2, None])
    letters = b[at]
    if frequent is not None:
        inside &= ~frequent[at]
    n = len(open_)
    size, i, j = np.zeros(n, np.int64), open_[:, 0].copy(), open_[:, 2].copy()
    suffix = np.zeros((n, wide + 1), np.int32)
    for k in range(high):
        here = open_[:, 0] + k
        live = here < open_[:, 1]
        same = (letters == a[np.where(live, here, 0)][:, None]) & inside & live[:, None]
        suffix[:, 1:] = (suffix[:, :-1] + 1) * same
        most = suffix.max(axis=1)
        better = np.flatnonzero(most > size)
        if len(better):
            size[better] = most[better]
            i[better] = here[better] + 1 - most[better]
            j[better] = open_[better, 2] + suffix[better].argmax(axis=1) - most[better]
    return size, i, j


def _grown(a: np.ndarray, b: np.ndarray, stretch: np.ndarray, size: int, i: int, j: int) -> tuple[int, int, int]:
    """A block and the equal letters beside it, frequent ones too."""
    a0, a1, b0, b1 = stretch.tolist()
    while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
        i, j, size = i - 1, j - 1, size + 1
    while i + size < a1 and j + size < b1 and a[i + size] == b[j + size]:
        size += 1
    return size, i, j


def matched(first: Sequence[str], second: Sequence[str]) -> np.ndarray:
    """Letters in the blocks of each pair."""
    a, at_a = _row(first)
    b, at_b = _row(second)
    frequent = _frequent(b, at_b)
    total = np.zeros(len(first), np.int64)
    pair = np.arange(len(first))
    open_ = np.stack([at_a[:-1], at_a[1:], at_b[:-1], at_b[1:]], axis=1)
    while True:
        some = (open_[:, 1] > open_[:, 0]) & (open_[:, 3] > open_[:, 2])
        pair, open_ = pair[some], open_[some]
        if not len(pair):
            return total
        size, i, j = (np.zeros(len(pair), np.int64) for _ in range(3))
        # stretches of about one size together: their lengths up to a power of two
        kind = np.ceil(np.log2(open_[:, 1] - open_[:, 0] + 1)) * 64 + np.ceil(np.log2(open_[:, 3] - open_[:, 2] + 1))
        order = np.argsort(kind, kind="stable")
        cuts = np.flatnonzero(np.diff(kind[order])) + 1
        for group in np.split(order, cuts):
            step = max(1, CELLS // int((open_[group, 3] - open_[group, 2]).max()))
            for k in range(0, len(group), step):
                g = group[k : k + step]
                size[g], i[g], j[g] = _longest(a, b, frequent, open_[g])
        if frequent is not None:
            for k in np.flatnonzero(at_b[pair + 1] - at_b[pair] >= FREQUENT).tolist():
                size[k], i[k], j[k] = _grown(a, b, open_[k], int(size[k]), int(i[k]), int(j[k]))
        np.add.at(total, pair, size)
        found = size > 0
        pair, open_, size, i, j = pair[found], open_[found], size[found], i[found], j[found]
        left = np.stack([open_[:, 0], i, open_[:, 2], j], axis=1)
        right = np.stack([i + size, open_[:, 1], j + size, open_[:, 3]], axis=1)
        pair, open_ = np.concatenate([pair, pair]), np.concatenate([left, right])


def bounds(first: Sequence[str], second: Sequence[str]) -> np.ndarray:
    """At least the similarity of each pair: from the letters that both have, counted in BINS classes."""
    counts = []
    for texts in (first, second):
        letters, at = _row(texts)
        who = np.repeat(np.arange(len(texts)), np.diff(at))
        counts.append(np.bincount(who * BINS + letters % BINS, minlength=len(texts) * BINS).reshape(len(texts), BINS))
    both = np.minimum(*counts).sum(axis=1)
    return 200.0 * both / np.maximum(1, counts[0].sum(axis=1) + counts[1].sum(axis=1))


def ratios(first: Sequence[str], second: Sequence[str], least: np.ndarray | None = None) -> np.ndarray:
    """Similarity of each pair, 0 to 100 and 0 where one is empty; 0 also where it can't be over least (if given)."""
    out = np.zeros(len(first))
    places: dict[tuple[str, str], int] = {}
    which = np.array([places.setdefault((x or "", y or ""), len(places)) for x, y in zip(first, second, strict=True)], np.int64)
    if not len(which):
        return out
    a, b = ([p[k] for p in places] for k in (0, 1))
    worth = np.array([bool(x and y) for x, y in places])
    if least is not None:
        lowest = np.full(len(places), np.inf)
        np.minimum.at(lowest, which, np.where(np.isnan(least), -np.inf, least))
        worth &= bounds(a, b) > lowest
    todo = np.flatnonzero(worth)
    one = np.zeros(len(places))
    if len(todo):
        x, y = [a[k] for k in todo], [b[k] for k in todo]
        one[todo] = 100.0 * (2.0 * matched(x, y) / np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)]))
    return one[which]


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest-matching-blocks similarity of two texts, 0 to 100; not symmetric, so the order of arguments counts."""
    return pd.Series(ratios(a.tolist(), b.tolist()))


@F.pandas_udf(T.DoubleType())
def ratio_over(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """ratio(), but 0 where the letters alone show that it isn't over least."""
    return pd.Series(ratios(a.tolist(), b.tolist(), least.to_numpy(dtype=float, na_value=np.nan)))
