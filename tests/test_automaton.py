"""The automaton against a search for each phrase, and the scores that it gives against those of an expression."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import automaton
from weftline.operators import taxonomy
from weftline.operators.taxonomy import Guardrail, Term


def plain(text, phrase, words=True):
    if words and not any(s in phrase for s in " -'&"):
        return len(re.findall(rf"(?<![a-z0-9]){re.escape(phrase)}(?![a-z0-9])", text))
    return text.count(phrase)


@pytest.mark.parametrize("lane", [2, 5, 256])
@pytest.mark.parametrize("words", [True, False])
def test_counts(monkeypatch, lane, words):
    monkeypatch.setattr(automaton, "LANE", lane)
    rng = random.Random(lane)
    for _ in range(150):
        phrases = list({"".join(rng.choice("ab é-'") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 14))})
        texts = ["".join(rng.choice("aab é-1X\0🙂'") for _ in range(rng.randint(0, 70))) for _ in range(rng.randint(0, 6))]
        got = {(int(t), int(p)): int(n) for t, p, n in zip(*automaton.Automaton(phrases, words).counts(texts), strict=True)}
        assert got == {(i, j): n for i, t in enumerate(texts) for j, p in enumerate(phrases) if (n := plain(t, p, words))}


def test_bounds(monkeypatch):
    assert [x.tolist() for x in automaton.Automaton([]).counts(["a"])] == [[], [], []]
    for bad in (["a", ""], ["a", "a"]):
        with pytest.raises(ValueError, match="distinct"):
            automaton.Automaton(bad)
    monkeypatch.setattr(automaton, "MOST_CELLS", 10)
    with pytest.raises(ValueError, match="cells"):
        automaton.Automaton(["abcdefgh"])
    monkeypatch.setattr(automaton, "BLOCK", 10)
    assert list(automaton.blocks([4, 4, 4, 50, 1, 0])) == [(0, 2), (2, 3), (3, 4), (4, 6)]


def test_scanned_equals_the_expression(spark, monkeypatch):
    rng = random.Random(1)
    word = lambda: rng.choice(["oak", "lamp", "oak lamp", "hi-fi", "d'or", "café", "of the", "the", "v1.5", "x&y"])
    terms = [Term(f"B{k % 4}", f"S{k % 9}", rng.choice([word(), f" {word().upper()} "])) for k in range(40)] + [Term("B0", "S0", " ")]
    rails = [Guardrail(tuple(word() for _ in range(3)), f"B{k % 5}", f"S{k % 11}", rng.randint(-9, 9), 1 + k % 3) for k in range(20)]
    rows = [(k, None if k == 3 else " ".join(rng.choice([word(), word().upper(), ",", "oaks", " "]) for _ in range(rng.randint(0, 40))), None if k == 4 else word()) for k in range(50)]
    rows += [(50, "the oak " * 5000, "")] + rows[:2]
    docs = spark.createDataFrame(rows, "id long, text string, source string").withColumn("__every", F.lit("clash")).drop("__every").repartition(3)
    key = lambda r: (r["id"], r["entries"])
    want = sorted(map(key, taxonomy.entries(docs, {"text": 2, "source": 1}, terms, rails, 100).collect()))
    got = taxonomy.scanned(docs, {"text": 2, "source": 1}, terms, rails, 100)
    assert sorted(map(key, got.collect())) == want and any(e for _, e in want)
    assert taxonomy.scanned(docs.limit(0), {"text": 2}, terms, rails).count() == 0
    table = spark.createDataFrame([(k, t.broad, t.sub, t.term) for k, t in enumerate(terms)] + [(99, "B", "S", None)], "ordinal int, broad string, sub string, term string")
    assert taxonomy.read_terms(table) == taxonomy.extend(terms[:-1], [])
    rules = spark.createDataFrame([(k, list(g.phrases), g.broad, g.sub, g.delta, g.min_hits) for k, g in enumerate(rails)], "ordinal int, phrases array<string>, broad string, sub string, delta int, min_hits int")
    assert taxonomy.read_rules(rules) == rails
    monkeypatch.setattr(taxonomy, "MOST_RULES", 10)
    with pytest.raises(ValueError, match="over 10"):
        taxonomy.read_rules(rules)
