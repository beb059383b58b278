"""Operators that SQL can't express, against plain recomputation, and awkward rows for all of them."""

import hashlib
import itertools
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, corpus, held, plain_components, plain_words, rows
from tests.test_entry import SF
from weftline.llm import bpe, chat_format, common, decontaminate, exact_dedup, jaccard_join, langid, line_dedup, quality, registry, suffix_dedup, toxicity

WORDS = "you are an idiot and a moron but he said that this is all she can do with it of the more in night at noon".split()


@pytest.fixture(scope="module")
def lm():
    rng = random.Random(3)
    raw = np.frombuffer(" ".join(rng.choice(WORDS) for _ in range(20000)).encode(), np.uint8)
    return toxicity.Language.of(toxicity.gram_counts(raw, np.array([0, len(raw)])))


def plain_grams(text: bytes, n: int) -> list[int]:
    fold = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text)
    return [(int.from_bytes(fold[k : k + n], "little") * int(langid.MULT[n]) & 0xFFFFFFFF) >> (32 - langid.BITS) for k in range(len(fold) - n + 1)]


def test_language_scores_by_hand(spark):
    rng = random.Random(2)
    made = [(i, " ".join("".join(rng.choices({"a": ["ka", "lo"], "b": ["sch", "über"]}[k], k=3)) for _ in range(rng.randint(1, 40))), k) for i in range(120) for k in [rng.choice("ab")]]
    df = spark.createDataFrame([*made, (500, "é", "a"), (501, "x", "a")], "doc_id long, text string, lang string")
    m = langid.train(df)
    got = rows(langid.identify(df, m))
    for i, text, _ in made[::7] + [(500, "é", "a"), (501, "x", "a")]:
        grams = [g for n in langid.ORDERS for g in plain_grams(text.encode(), n)]
        z = [(sum(float(m.table[c][g]) for g in grams) / max(1, len(grams)) + float(m.bias[c])) / m.temperature for c in range(len(m.langs))]
        p = [math.exp(x - max(z)) for x in z]
        p = [x / sum(p) for x in p]
        assert got[i]["lang_pred"] == m.langs[p.index(max(p))] and got[i]["score"] == pytest.approx(max(p), abs=1e-6)


def plain_quality(m, text: str) -> float:
    """The score from the definition: shares of words, pairs, pairs of shapes, and patterns of equal words."""
    raw = text.encode()
    kinds = ["s" if c == 32 or 9 <= c <= 13 else "l" if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else "d" if 48 <= c <= 57 else "o" for c in raw]
    words, k = [], 0
    for kind, run in itertools.groupby(kinds):
        n = len(list(run))
        if kind != "s":
            words.append((kind, raw[k : k + n]))
        k += n
    mask, r = (1 << 64) - 1, 0x100000001B3
    hash_ = lambda w: sum((c + 1) * pow(r, j, 1 << 64) for j, c in enumerate(w)) & mask
    bucket = lambda h: (((h ^ (h >> 31)) * 0x9E3779B97F4A7C15 & mask) >> (64 - quality.BITS))
    k1, k2, k3 = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5

    def shape(kind, w):
        if kind != "l":
            return 4 if kind == "d" else 4 + min(len(w), 3)
        big = sum(65 <= c <= 90 for c in w)
        return 0 if not big else 2 if big == len(w) and len(w) > 1 else 1 if big == 1 and 65 <= w[0] <= 90 else 3

    hs, shapes, z = [hash_(w) for _, w in words], [shape(*w) for w in words], 0.0
    for j, h in enumerate(hs):
        last = hs[j - 1] if j else k1
        before = hs[j - 2] if j > 1 else k2
        pattern = (2 * (h == last) + (h == before)) * 16 + shapes[j]
        for x in (h, last * k3 + h, ((shapes[j - 1] if j else 15) * 16 + shapes[j] + 1) * k1, (pattern + 7) * k2):
            z += float(m.weights[bucket(x & mask)])
    z = m.bias + quality.SCALE * z / max(1, len(hs))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_quality_scores_by_hand(spark):
    texts = [t for _, t in corpus()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int")
    m = quality.train(docs, labels)
    got = rows(quality.score(docs, m))
    assert len({round(r["score"], 9) for r in got.values()}) > 20
    for i, t in enumerate(texts):
        assert got[i]["score"] == pytest.approx(plain_quality(m, t or ""), abs=1e-5)
        assert got[i]["predicted"] == (got[i]["score"] >= 0.3) and got[i]["held_out"] == held(i)


def plain_decode(written: str, lm) -> float:
    """The best score of any reading of a place without separators, by trying all of them."""
    best = -math.inf
    for reads in itertools.product(*[[(c, 0.0)] * c.isalpha() + [(x, -0.7) for x in toxicity.LEET.get(c, "")] for c in written]):
        for copies in itertools.product([False, True], repeat=len(written) - 1):
            score, context, last, ok = 0.0, 0, "", True
            for k, ((letter, cost), sign) in enumerate(zip(reads, written, strict=True)):
                symbol = ord(letter) - 96
                if k and copies[k - 1]:
                    if last[:1] != sign or context % toxicity.SYMBOLS != symbol:
                        ok = False
                        break
                    score -= 3.0 if last == sign else 0.5
                    last = sign + sign
                    continue
                score += cost + float(lm.table[context * toxicity.SYMBOLS + symbol])
                context, last = (context * toxicity.SYMBOLS + symbol) % toxicity.SYMBOLS**3, sign
            if ok:
                best = max(best, score + float(lm.table[context * toxicity.SYMBOLS]))
    return best


def score_of(read: str, written: str, lm) -> float:
    """The best score of the one reading: the places where letters are dropped are tried."""
    best = -math.inf
    for reads in itertools.product(*[[(c, 0.0)] * c.isalpha() + [(x, -0.7) for x in toxicity.LEET.get(c, "")] for c in written]):
        for copies in itertools.product([False, True], repeat=len(written) - 1):
            kept = "".join(r[0] for k, r in enumerate(reads) if not (k and copies[k - 1]))
            if kept != read:
                continue
            score, context, last, ok = 0.0, 0, "", True
            for k, ((letter, cost), sign) in enumerate(zip(reads, written, strict=True)):
                symbol = ord(letter) - 96
                if k and copies[k - 1]:
                    if last[:1] != sign or context % toxicity.SYMBOLS != symbol:
                        ok = False
                        break
                    score -= 3.0 if last == sign else 0.5
                    last = sign + sign
                    continue
                score += cost + float(lm.table[context * toxicity.SYMBOLS + symbol])
                context, last = (context * toxicity.SYMBOLS + symbol) % toxicity.SYMBOLS**3, sign
            if ok:
                best = max(best, score + float(lm.table[context * toxicity.SYMBOLS]))
    return best


def test_decoding_finds_the_likeliest_reading(lm):
    rng = random.Random(12)
    places = ["1d10t", "m0r0n", "iidiot", "n00n", "th1s", "5he", "morrron", *["".join(rng.choices("abdeimnorst1035", k=rng.randint(1, 6))) for _ in range(60)]]
    for w in places:
        read = toxicity.decode(w, lm)
        assert " " not in read and score_of(read, w, lm) == pytest.approx(plain_decode(w, lm), abs=1e-4), w


def test_short_cut_for_doubled_letters(lm):
    rng = random.Random(13)
    words = ["moron", "morron", "noon", "idiiot", "caan", "aa", *["".join(rng.choices("adehimnorst", k=rng.randint(2, 7))) for _ in range(2000)]]
    taken = [w for w in words if toxicity.doubled(w) >= 0]
    read = toxicity.Restorer(lm).read_once
    assert len(taken) > 300 and [w for w in taken if read(w) != toxicity.decode(w, lm)] == [] and read("morron") == "moron" and read("noon") == "noon"


def test_long_places_are_decoded_whole(lm):
    rng = random.Random(4)
    said = [rng.choice(["idiot", "moron", "she", "can", "that"]) for _ in range(120)]
    written = " ".join(" ".join(w) + "." for w in said)
    assert len(written) > 1000
    read = toxicity.decode(written, lm).split()
    assert read.count("idiot") >= said.count("idiot") - 2 and read.count("moron") >= said.count("moron") - 2
    halves = toxicity.decode(written[: len(written) // 2], lm).split()
    assert read[: len(halves) - 2] == halves[:-2]


def test_toxicity_scores_by_hand(spark, lm):
    model = toxicity.Model(lm, {"idiot$": 4.0, "idi": 1.0, "moro": 2.0}, -2.0, -0.1)
    texts = ["an idiot", "1d10t!", "more moron", "fine", "", None, "Idiotic"]
    got = rows(toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, restored=True))
    for i, t in enumerate(texts):
        words = got[i]["restored"].split()
        z = -2.0 - 0.1 * math.log1p(len(words)) + sum(model.weights.get(f, 0) for w in {x for p in words for x in re.findall(r"[^\W\d_]+", p)} for f in [w + "$", *[w[:k] for k in range(3, min(len(w), 10) + 1)]])
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)
    assert got[1]["restored"].split()[0] == "idiot" and got[1]["predicted"] == 1 and got[3]["predicted"] == 0


def plain_line_dedup(texts):
    first: dict = {}
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").lower()
    for i, t in sorted(texts.items()):
        for x in (t or "").split("\n"):
            first.setdefault(key(x), i)
    return {i: "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or first[key(x)] == i) for i, t in texts.items()}


def test_updates_touch_only_the_shards_they_hit(spark):
    texts = {i: "\n".join([f"line of its own {i}", f"line of some {i % 7}"]) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    index = line_dedup.build(df, shards=8)
    more = spark.createDataFrame([(100, "line of some 3\nquite new line")], "doc_id long, text string")
    grown = line_dedup.insert(index, more)
    changed = {r[0] for r in grown.refs.join(index.refs, ["key", "refs", "first"], "left_anti").select("shard").distinct().collect()}
    assert 1 <= len(changed) <= 2
    assert {r[0]: r["kept"] for r in line_dedup.kept(df.unionByName(more), line_dedup.compact(grown)).collect()} == plain_line_dedup(texts | {100: "line of some 3\nquite new line"})
    back = line_dedup.delete(grown, spark.createDataFrame([(100,), (3,), (None,)], "doc_id long"))
    fresh = line_dedup.build(df.filter("doc_id <> 3"), shards=8)
    assert sorted(map(str, back.refs.select("key", "refs", "first").collect())) == sorted(map(str, fresh.refs.select("key", "refs", "first").collect()))
    from weftline.llm.cuckoo import Cuckoo

    cells = {r["shard"]: Cuckoo.from_bytes(r["cells"]) for r in back.filters.collect()}
    keys = back.refs.select("shard", "key").collect()
    assert len(cells) == back.filters.count() and all(cells[r["shard"]].contains(line_dedup.Shard.marks([r["key"]]))[0] for r in keys)


def test_filters_that_are_full_grow(spark):
    df = spark.createDataFrame([(1, "the only line there is")], "doc_id long, text string")
    lots = spark.createDataFrame([(2, "\n".join(f"one of very many lines {k}" for k in range(6000)))], "doc_id long, text string")
    grown = line_dedup.insert(line_dedup.build(df, shards=1), lots)
    (cells,) = grown.filters.collect()
    from weftline.llm.cuckoo import Cuckoo

    f = Cuckoo.from_bytes(cells["cells"])
    assert grown.refs.count() == 6001 and f.contains(line_dedup.Shard.marks([r["key"] for r in grown.refs.collect()])).all()


def test_long_texts_go_linearly_and_by_a_real_shuffle(spark, monkeypatch):
    rng = random.Random(9)
    w = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:12])), (3, None), (None, " ".join(w[5000:5010])), (2, " ".join(w[:12]))], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w[k : k + 14])) for k in range(0, 19_000, 1000)], "item_id long, text string")
    seen = decontaminate.report(docs, bench)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = decontaminate.report(docs, bench)
        plan = shuffled._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan
        key = lambda r: str(tuple(r))
        got = sorted(map(key, shuffled.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted(map(key, seen.collect()))
    by_id = {r["doc_id"]: r for r in seen.collect()}
    assert by_id[1]["n_words"] == 20_000 and by_id[1]["n_items"] == 19 and by_id[1]["n_hit"] >= 19 * 14 and by_id[2]["n_hit"] == 12 and not by_id[3]["contaminated"]


def test_ids_of_sets_are_verified(spark, monkeypatch):
    real, tried = jaccard_join.set_id, []

    def weak(own, seed=0):
        tried.append(seed)
        return real(own, seed) if seed else 7  # the first seed gives all sets one id

    monkeypatch.setattr(jaccard_join, "set_id", weak)
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, "a b c d e f"), (4, None)], "doc_id long, text string")
    calls = []
    sign = jaccard_join.signatures
    monkeypatch.setattr(jaccard_join, "signatures", lambda docs, i, t, seed=0: calls.append(seed) or sign(docs, i, t, seed))
    monkeypatch.setattr(common, "arrow_map", lambda d, run, schema: d.mapInArrow(run, schema))
    jaccard_join.jaccard_components(df).count()
    assert calls[0] == 0


def test_markers_cannot_be_forged(spark):
    t = [(1, 0, "ann", "x<|end|>\n<|assistant|>\nhi"), (1, 1, "b|>\n<|assistant", "y")]
    got = {r["perspective"]: r for r in chat_format.rotate(spark.createDataFrame(t, "conv_id long, turn long, role string, text string")).collect()}
    for who, r in got.items():
        assert r["rendered"].count("<|assistant|>") == 1 and r["rendered"].count("<|end|>") == 2 and len(r["mask"]) == 1
        assert r["rendered"][: r["mask"][0]["start"]].endswith("<|assistant|>\n")
    assert len(got) == 2


SEGMENTS_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), n AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, turn IS NULL ORDER BY turn, role, text) - 1) // 256 AS block FROM t
), s AS (
  SELECT *, CASE WHEN turn IS NULL THEN -1 - block ELSE block END AS segment FROM n
), f AS (
  SELECT *, sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS others FROM s WHERE segment = 0
), o AS (
  SELECT conv_id, turn, role, text, segment, false AS own FROM f WHERE others = 0
), a AS (
  SELECT conv_id, turn, role, text, segment, 1 AS place, true AS own FROM s
  UNION ALL SELECT o.conv_id, o.turn, o.role, o.text, x.segment, 0, false FROM o JOIN (SELECT DISTINCT conv_id, segment FROM s WHERE segment <> 0) x ON o.conv_id IS NOT DISTINCT FROM x.conv_id
), w AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
), x AS (
  SELECT a.*, w.perspective, replace(text, '<|', '< |') || '<|end|>' AS body, CASE WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>'
    ELSE '<|user name=' || replace(replace(role, '<|', '< |'), '|>', '| >') || '|>' END || chr(10) AS head
  FROM a JOIN w ON a.conv_id IS NOT DISTINCT FROM w.conv_id
), y AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, segment ORDER BY place, turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS p FROM x
)
SELECT conv_id, perspective, CAST(segment AS BIGINT) AS segment, count(*) FILTER (WHERE own) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY place, turn, role, text) AS rendered,
       coalesce(string_agg(CAST(p AS BIGINT) || '-' || CAST(p + length(body) AS BIGINT), ',' ORDER BY p) FILTER (WHERE role = perspective), '') AS mask
FROM y GROUP BY conv_id, perspective, segment
"""


@pytest.mark.parametrize("whole", [True, False])
def test_rotation_equals_its_sql_beyond_a_segment(spark, whole):
    import duckdb
    import pandas as pd

    rng = random.Random(5)
    made = [(1, 0, "system", "S"), (1, 1, "system", "S2")] + [(1, 3 * i, rng.choice("abc"), f"t{i}") for i in range(1, 1000)] + [(2, None, rng.choice("ab"), f"n{i}") for i in range(300)] + [(2, 1, "a", "after")]
    made += [(3, 0, "system", "only")] + [(4, i % 5, "a", "same") for i in range(600)] + [(None, i, "zz"[: 1 + i % 2], "<|end|>") for i in range(300)] + [(5, 0, "a", None), (5, 0, None, "x" * 200_000), (5, 1, "|>", "é")]
    clash = ", conv string, c string, o string, segment string, said string, lines string, parts string, range string"
    df = spark.createDataFrame([(*m, *[None] * 8) for m in made], "conv_id long, turn long, role string, text string" + clash).repartition(5)
    got = (chat_format.perspectives if whole else chat_format.rotate)(df)
    names = [c for c in got.columns if c != "mask"]
    got = sorted(str((*[r[c] for c in names], ",".join(f"{a}-{b}" for a, b in r["mask"]))) for r in got.collect())
    frame = pd.DataFrame(made, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", frame)
    sql = chat_format.SQL if whole else SEGMENTS_SQL
    assert got == sorted(map(str, con.execute(f"SELECT {', '.join(names)}, mask FROM ({sql})").fetchall()))
    if whole:
        assert sum("(1, 'a', 1001," in g for g in got) == 1 and len(got) == 3 + 2 + 1 + 2 + 3


AWKWARD = [(None, "same text for all of them here"), (1, None), (1, None), (2, ""), (3, "same text for all of them here"), (3, "same text for all of them here"), (4, "same text for all of them here"), (5, "x" * 400_000), (6, "a b " * 50_000), (7, "\n" * 1000), (8, "漢" * 3000)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Null, repeated and tied ids, null, empty and long texts, and columns with every name that operators use inside."""
    names = ["__id", "__text", "__held", "__row", "__drop", "__digest", "digest", "_digest", "t", "id", "w", "h", "key", "node", "run", "shard", "score", "held_out", "predicted", "spans", "n", "items", "at", "block"]
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    return df.withColumns({c: F.lit(f"clash {c}") for c in names}).withColumn("lang", F.when(F.col("doc_id") > 2, "en")).repartition(3)


def test_awkward_rows_and_clashing_columns(spark, awkward, lm):
    n = len(AWKWARD)
    ids = sorted(str(i) for i, _ in AWKWARD)
    same = lambda df: sorted(str(r["doc_id"]) for r in df.collect()) == ids
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 1), (4, 1, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "same text for all of them here"), (1, None), (None, "x y z")], "item_id long, text string").withColumns({c: F.lit("c") for c in ("window", "items", "len", "key")})
    assert same(langid.identify(awkward, langid.train(awkward)))
    assert same(line_dedup.kept(awkward, line_dedup.build(awkward)))
    assert same(quality.score(awkward, quality.train(awkward, labels)))
    assert same(suffix_dedup.dedup(awkward))
    lines, pattern = bpe.production()
    enc = bpe.encode(awkward, lines, pattern, decoded=True)
    assert same(enc) and sorted(bytes(r["decoded"]) for r in enc.collect()) == sorted((t or "").encode() for _, t in AWKWARD)
    got = decontaminate.report(awkward, bench)
    assert same(got) and got.filter("contaminated").count() == 4
    got = rows(jaccard_join.jaccard_components(awkward))
    assert got[3]["component_id"] == got[4]["component_id"] == 3 and got[1]["component_id"] == 1 and got[1]["n_shingles"] == 0
    assert same(jaccard_join.jaccard_components(awkward))
    got = exact_dedup.exact_groups(awkward)
    assert same(got) and {r["doc_id"]: r["group_size"] for r in got.collect()}[4] == 4
    assert same(toxicity.score(awkward, toxicity.train(awkward, labels)))
    for f in (exact_dedup.dedup, jaccard_join.dedup, lambda d: quality.keep_good(d, quality.train(d, labels)), lambda d: decontaminate.remove_documents(d, bench)):
        out = f(awkward)
        assert out.columns == awkward.columns and 0 < out.count() <= n
    one = awkward.filter("doc_id = 4")
    assert jaccard_join.dedup(one).drop("doc_id", "text").first() == one.drop("doc_id", "text").first()


def test_string_ids(spark):
    df = spark.createDataFrame([("b", "q" * 80), ("a", "q" * 80), ("c", "other text of its own kind")], "doc_id string, text string")
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(df).collect()} == {"a": "a", "b": "a", "c": "c"}
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(df).collect()} == {"a": "a", "b": "a", "c": "c"}
    with pytest.raises(ValueError, match="integer"):
        suffix_dedup.dedup(df)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_pipeline_by_hand(spark):
    """The stages after the classifier against plain Python, and the classifier's stage against its own scores recomputed."""
    import tiktoken

    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    m = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {i: t for i, t in texts.items() if plain_quality(m, t or "") >= 0.3}
    assert 0 < len(left) < len(texts)
    first: dict = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i] or ""), i)
    left = {i: left[i] for i in first.values()}
    _, top = plain_components(left)
    left = {i: t for i, t in left.items() if top[i] == i}
    wins = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        v = plain_words(r["text"])
        wins |= {tuple(v[s : s + 10]) for s in range(max(1, len(v) - 9))} if v else set()
    sizes = {len(x) for x in wins}
    hit = lambda t: any(tuple(w[k : k + n]) in wins for w in [plain_words(t)] for n in sizes for k in range(len(w) - n + 1))
    left = {i: t for i, t in left.items() if not hit(t)}
    lines, pattern = bpe.production()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.Codec(lines, pattern).ranks, special_tokens={})
    got = rows(p.run(spark, SF))
    assert set(got) == set(left)
    for i, t in left.items():
        assert bytes(got[i]["ids"]) == b"".join(x.to_bytes(4, "little") for x in enc.encode_ordinary(t or "")) and got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_pipeline_on_awkward_and_empty_rows(spark, awkward, tmp_path):
    import corpus_pipeline as p

    cols = spark.createDataFrame([], SCHEMA)
    for docs, name in ((awkward.drop("score"), "a"), (cols, "e")):
        where = str(tmp_path / name)
        docs.write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame([(3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
        spark.createDataFrame([(None, None), ("i", "no such words")], "item_id string, text string").write.parquet(f"{where}/benchmark.parquet")
        left = spark.read.parquet(f"{where}/documents.parquet")
        for _, stage in p.STAGES[:-1]:
            after = stage(spark, left, where)
            assert after.columns == left.columns and after.count() <= left.count()
            left = after
        assert p.run(spark, where).count() == left.count()


def test_very_long_texts_in_pieces_are_the_same(monkeypatch, spark):
    rng = random.Random(8)
    text = " ".join(rng.choice(["oak", "Ünder", "12", "%%%", "x" * 90, "lamp!", "\t"]) for _ in range(3000)).encode()
    raw, edges = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    weights = np.random.default_rng(1).normal(size=1 << quality.BITS).astype(np.float32) / 100
    model = quality.Model(weights, 0.1)
    speech = langid.Model(["a", "b"], np.random.default_rng(2).normal(size=(2, (1 << langid.BITS) + 1)).astype(np.float32), np.zeros(2))
    speech.table[:, -1] = 0
    whole = model.scores(raw, edges), speech.logits(raw, edges), jaccard_join.shingle_sets(raw, edges)
    for size in (64, 1000, 4096):
        monkeypatch.setattr(common, "PIECE", size)
        assert model.scores(raw, edges) == pytest.approx(whole[0], abs=1e-9)
        assert speech.logits(raw, edges) == pytest.approx(whole[1], abs=1e-9)
        assert (jaccard_join.shingle_sets(raw, edges)[0] == whole[2][0]).all()
    blank = np.frombuffer(b" " * 5000, np.uint8)
    assert len(jaccard_join.shingle_sets(blank, np.array([0, 5000]))[0]) == 0 and model.scores(blank, np.array([0, 5000]))[0] == pytest.approx(1 / (1 + math.exp(-0.1)))


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 14)]
