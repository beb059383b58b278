"""The matching of blocks against the standard library's, which has the same definition."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from weftline.functions import similarity


def plain(a, b):
    return 100 * SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def pairs(n, size, seed):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice(["ab", "abc ", "abcdefgh é🙂", " abcdefghijklmnopqrstuvwxyz"])
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, size)))
        yield a, "".join(rng.choice(letters) for _ in range(rng.randint(0, size))) if rng.random() < 0.5 else "".join(c if rng.random() < 0.8 else rng.choice(letters) for c in a)


@pytest.mark.parametrize(("n", "size"), [(100_000, 24), (150, 600)])
def test_ratios(n, size):
    a, b = zip(*pairs(n, size, size), strict=True)
    want = [plain(x, y) for x, y in zip(a, b, strict=True)]
    assert similarity.ratios(a, b).tolist() == want
    bound = similarity.bounds(a, b)
    assert (bound >= np.array(want) - 1e-9).all()
    least = np.array([random.Random(k).choice([0.0, 50.0, 70.0, 99.0, np.nan]) for k in range(n)])
    over = similarity.ratios(a, b, least)
    for got, true, low in zip(over, want, least, strict=True):
        assert got == true or (got == 0 and true <= low)


def test_small_tables(monkeypatch):
    monkeypatch.setattr(similarity, "CELLS", 10)
    a, b = zip(*pairs(300, 30, 5), strict=True)
    assert similarity.ratios(a, b).tolist() == [plain(x, y) for x, y in zip(a, b, strict=True)]
    assert similarity.ratios([], []).tolist() == [] and similarity.ratios([None, "a"], ["x", None]).tolist() == [0, 0]


def test_frequent_letters_begin_no_block():
    b = "ab" * 150 + "xyz"
    for a in ("abab", "xyz", "bxyz", "ab" * 150, "zab" * 40):
        assert similarity.ratios([a], [b])[0] == plain(a, b)
