"""Each operator against a plain version of its contract, on texts that hold the awkward cases."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from weftline.llm import bpe, chat_format, common, decontaminate, exact_dedup, jaccard_join, langid, line_dedup, quality, suffix_dedup, toxicity

WS = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, key string, run long"


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def corpus() -> list[tuple]:
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ÉT", "su", "ré", "na"]) for _ in range(rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage, shared = line(70), line(9)
    texts = [None, "", " \t\n ", "x", "12 34 %%%", "a b c", "A  b\tC", "漢字 🙂 é", "\n\n", "no\nno\nno", "q" * 300, "ab" * 200]
    for i in range(40):
        texts.append("\n".join([line(rng.randint(3, 40)), shared.upper() if i % 3 == 0 else " " + shared + "\t", line(12), passage if i % 5 == 0 else line(4), shared if i % 7 == 0 else line(2)]))
    for i in range(12, 30):
        w = texts[i].split(" ")
        w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [texts[15], texts[15].replace(" ", "\n"), texts[20] + " ", texts[14] * 60, texts[2]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, None, None, "clash", 1, "clash", 2) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_exact_dedup(docs, empty):
    groups: dict = {}
    for i, t in corpus():
        groups.setdefault(WS.sub(" ", t or ""), []).append(i)
    got = rows(exact_dedup.exact_groups(docs, leaf_rows=4, fan=2))
    assert len(got) == len(corpus())
    for flat, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(ids), len(ids), i == min(ids), sha(flat.encode()))
    assert sorted(r["doc_id"] for r in exact_dedup.dedup(docs).collect()) == sorted(min(x) for x in groups.values())
    assert exact_dedup.dedup(docs).columns == docs.columns
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (None, "b"), (5, "z"), (5, "a")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df).collect())
    assert got == [("3", "3", 4, True), ("3", "3", 4, True), ("5", "3", 4, False), ("5", "5", 1, True), ("None", "3", 4, False), ("None", "None", 1, True)]
    assert sorted(str(r["text"]) for r in exact_dedup.dedup(df).collect()) == ["a", "a", "a", "b", "z"]


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST, 0])
def test_decontamination(spark, docs, empty, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", limit)  # 0: the windows are joined by a shuffle
    texts = dict(corpus())
    long = max((t for t in texts.values() if t), key=len)
    items = [(1, " ".join(plain_words(long)[3:20])), (2, "a b C"), (3, None), (4, ""), (10, " ".join(plain_words(long)[8:18])), (11, "never seen here"), (2, "a b C")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in texts.items():
        w, hit, met = plain_words(t), set(), set()
        for k, x in items:
            v = plain_words(x)
            for s in range(max(1, len(v) - 9)) if v else ():
                win = v[s : s + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        met.add(str(k))
        want[i] = (len(w), len(hit), len(met), sha(",".join(sorted(met)).encode()), bool(hit))
    got = decontaminate.report(docs, bench)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert sum(w[4] for w in want.values()) > 2
    left = {r["doc_id"] for r in decontaminate.remove_documents(docs, bench).collect()}
    assert left == {i for i, w in want.items() if not w[4]}
    cut = rows(decontaminate.remove_spans(docs, bench))
    for i, t in texts.items():
        assert cut[i]["text"] == t if not want[i][4] else len(plain_words(cut[i]["text"])) == want[i][0] - want[i][1]
    assert decontaminate.report(empty, bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_line_dedup(spark, docs, empty):
    texts = dict(corpus())

    def expected(texts):
        key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(LOWER)
        first: dict = {}
        for i, t in sorted(texts.items()):
            for x in (t or "").split("\n"):
                if len(key(x)) >= 10:
                    first.setdefault(key(x), i)
        out = {}
        for i, t in texts.items():
            lines = (t or "").split("\n")
            stay = [x for x in lines if len(key(x)) < 10 or first[key(x)] == i]
            out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
        return out

    index = line_dedup.build(docs, shards=3)
    want = expected(texts)
    assert {r[0]: tuple(r)[1:] for r in line_dedup.kept(docs, index).collect()} == want and sum(w[1] for w in want.values()) > 10
    # insertions and deletions leave what a fresh index of the rest has
    a, b = docs.filter("doc_id % 4 <> 1"), docs.filter("doc_id % 4 = 1")
    grown = line_dedup.insert(line_dedup.build(a, shards=3), b)
    assert {r[0]: tuple(r)[1:] for r in line_dedup.kept(docs, grown).collect()} == want
    shrunk = line_dedup.delete(grown, b.select("doc_id"))
    assert {r[0]: tuple(r)[1:] for r in line_dedup.kept(a, shrunk).collect()} == expected({i: t for i, t in texts.items() if i % 4 != 1})
    fresh = line_dedup.build(a, shards=3)
    assert sorted(map(str, shrunk.refs.select("key", "refs", "first").collect())) == sorted(map(str, fresh.refs.select("key", "refs", "first").collect()))
    assert line_dedup.kept(empty, line_dedup.build(empty)).count() == 0


def test_cuckoo():
    import numpy as np

    from weftline.llm.cuckoo import Cuckoo, Full

    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 6000, dtype=np.uint64)
    f = Cuckoo(7000)
    f.insert(keys)
    assert f.contains(keys).all() and f.contains(rng.integers(0, 2**63, 20000, dtype=np.uint64)).mean() < 0.01
    f.delete(keys[:3000])
    again = Cuckoo.from_bytes(f.to_bytes())
    assert again.contains(keys[3000:]).all() and again.contains(keys[:3000]).mean() < 0.01
    with pytest.raises(Full):
        Cuckoo(10).insert(keys)
    s = line_dedup.Shard()
    data = [bytes([i % 256, i // 256] * 8) for i in range(5000)]
    s.insert(data, [1] * 5000, list(range(5000)))
    s.insert(data[:10], [2] * 10, [-1] * 10)
    assert s.table[data[3]] == (3, -1) and len(s.table) == 5000 and s.confirmed >= 10


def plain_passages(texts: dict) -> dict:
    first: dict = {}
    for i, t in sorted(texts.items()):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = {}
    for i, t in texts.items():
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize(("hot", "piece"), [(suffix_dedup.HOT, suffix_dedup.PIECE), (1, 4000)])
def test_suffix_dedup(docs, empty, monkeypatch, hot, piece):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)  # 1: every shared anchor goes the way of the hot ones
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    want = plain_passages(dict(corpus()))
    assert {r[0]: (*tuple(r)[1:4], bytes(r[4])) for r in suffix_dedup.dedup(docs).collect()} == want and sum(w[1] for w in want.values()) > 1000
    assert suffix_dedup.dedup(empty).count() == 0


def test_suffix_dedup_ids(spark):
    t = "abcdefghij" * 7
    df = spark.createDataFrame([(1, t), (1, t + "x"), (None, t), (2, "zz" + t)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in suffix_dedup.dedup(df).collect())
    assert got == [("1", 0), ("1", 0), ("2", 70), ("None", 0)]


def test_transform_against_sorting():
    from weftline.llm import bwt

    rng = random.Random(3)
    for trial in range(30):
        cap = rng.choice([3, 50])
        strings = [bytes(rng.choice(b"ab" if trial % 2 else b"abcz\x00\xff") for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 20))]
        _, owner, length, lcp = bwt.of_bytes(strings, cap)
        got = [strings[o][len(strings[o]) - n :] for o, n in zip(owner, length, strict=True)]
        assert got == sorted((s[k:] for s in strings for k in range(len(s) + 1)))
        same = [0] + [min(cap, next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))) for a, b in zip(got, got[1:], strict=False)]
        assert lcp.tolist() == same


def plain_components(texts: dict, per_cent: int = 75) -> tuple[dict, dict]:
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: len(s) for i, s in sets.items()}, {i: find(i) for i in texts}


@pytest.mark.parametrize(("most", "small", "common_"), [(2_000_000, 128, 64), (60, 2, 3)])
def test_jaccard_join(docs, empty, monkeypatch, most, small, common_):
    for name, value in (("MOST_SHINGLES", most), ("SMALL", small), ("COMMON", common_)):
        monkeypatch.setattr(jaccard_join, name, value)  # small values: large components are divided, regions taken whole
    sizes, tops = plain_components(dict(corpus()))
    got = rows(jaccard_join.jaccard_components(docs))
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert {i: r["component_id"] for i, r in got.items()} == tops and len(set(tops.values())) < len(tops) - 5
    assert {r["doc_id"] for r in jaccard_join.dedup(docs).collect()} == set(tops.values())
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_solver():
    import numpy as np

    rng = np.random.default_rng(5)
    base = [rng.choice(10**6, 60, replace=False) for _ in range(12)]
    sets = []
    for k in range(150):
        s = base[k % 12].copy()
        n = int(rng.integers(0, 14))
        s[:n] = rng.choice(10**6, n) + 10**6
        sets.append(np.unique(s).astype(np.uint64))
    top = jaccard_join.Forest(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                top.join(a, b)
    for sweep in (4, 64, 1000):
        assert (jaccard_join.solve(sets, sweep=sweep).labels() == top.labels()).all()


def test_bpe_against_the_library(docs, empty):
    import tiktoken

    lines, pattern = bpe.production()
    codec = bpe.Codec(lines, pattern)
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})
    got = rows(bpe.decode(bpe.encode(docs, lines, pattern), lines))
    assert {i: bytes(r["decoded"]) for i, r in got.items()} == {i: bytes(r["decoded"]) for i, r in rows(bpe.encode(docs, lines, pattern, decoded=True)).items()}
    for i, t in corpus():
        ids = other.encode_ordinary(t or "")
        assert bytes(got[i]["ids"]) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert got[i]["n_tokens"] == len(ids) and bytes(got[i]["decoded"]) == (t or "").encode()
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(" \t\n\x1cabAB'sé漢🙂0.²­") for _ in range(rng.randint(0, 60)))
        assert codec.encode([t])[0] == b"".join(x.to_bytes(4, "little") for x in other.encode_ordinary(t))
    long = "".join(rng.choice("abcdeé") for _ in range(3000))
    assert codec.encode([long])[0] == b"".join(x.to_bytes(4, "little") for x in other.encode_ordinary(long))
    assert bpe.digests(empty, lines, pattern).count() == 0


def held(i) -> bool:
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_id(spark, empty):
    rng = random.Random(8)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "über"], "cc": ["ção", "lh", "que"]}
    made = [(i, " ".join("".join(rng.choices(parts[k], k=3)) for _ in range(rng.randint(5, 60))), k) for i in range(240) for k in [rng.choice(sorted(parts))]]
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (1003, "漢字", None), (1004, "é", "cc")]
    df = spark.createDataFrame(made + extra, "doc_id long, text string, lang string")
    model = langid.train(df)
    got = rows(langid.identify(df, model))
    out = [(got[i]["lang_pred"], k) for i, _, k in made if held(i)]
    assert len(out) > 30 and sum(a == b for a, b in out) / len(out) > 0.95
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_pred"] != "und" and got[1004]["lang_pred"] != "und"
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 for i, r in got.items()) and not got[1002]["accepted"]
    assert langid.train(empty) is None and langid.identify(df, None).filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0
    nulls = langid.identify(spark.createDataFrame([(None, "kalomi")], "doc_id long, text string"), model).first()
    assert nulls["doc_id"] is None and nulls["held_out"] is False


def test_quality(spark, empty):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices(["ka", "lo", "mi", "su"], k=3))
    made, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        w = [word() for _ in range(rng.randint(8, 60))]
        made.append((i, " ".join(w if good else [x + "%%%" for x in w] if i % 8 else [x for x in w[:4] for _ in range(6)])))
        labels.append((i, int(good), 0))
    df = spark.createDataFrame([*made, (900, None), (901, "")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(df, lab)
    got = rows(quality.score(df, model))
    out = [(got[i]["predicted"], y) for i, y, _ in labels if held(i)]
    assert sum(a == b for a, b in out) / len(out) > 0.95
    assert got[900]["score"] == got[901]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert quality.score(empty, model).count() == 0
    assert quality.score(df, quality.train(df, lab.limit(0))).first()["score"] == 0.5
    assert quality.keep_good(df, model).columns == df.columns


def test_toxicity(spark, empty):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices(["ka", "lo", "mi", "su", "ten", "id", "mor", "on"], k=3))
    bad = ["idiot", "moron"]
    made, labels = [], []
    for i in range(500):
        w = [word() for _ in range(rng.randint(10, 60))]
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        made.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    hidden = ["1d10t", "i d i o t", "m0r0n", "iiidiooot", "m-o-r-o-n", "M O R O N", "mor0nnn"]
    made += [(1000 + k, " ".join([word() for _ in range(15)] + [h] + [word() for _ in range(15)])) for k, h in enumerate(hidden)]
    df = spark.createDataFrame([*made, (2000, None), (2001, "")], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab)
    got = rows(toxicity.score(df, model, restored=True))
    out = [(got[i]["predicted"], y) for i, _, y in labels if held(i)]
    assert sum(a == b for a, b in out) / len(out) > 0.97
    assert [h for k, h in enumerate(hidden) if not got[1000 + k]["predicted"]] == []
    assert got[2000]["score"] == got[2001]["score"] < 0.5
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.score(df, toxicity.train(df, lab.limit(0))).filter("predicted = 1").count() == 0


def test_filter_routes_keys():
    class Table(dict):
        asked = 0

        def get(self, key, default=None):
            self.asked += 1
            return super().get(key, default)

    shard, want = line_dedup.Shard(table=None), {}
    shard.table = Table()
    rng = random.Random(4)
    for batch in range(6):
        keys = [hashlib.md5(b"%d" % rng.randrange(4000)).digest() for _ in range(1000)]
        met = len({k for k in keys if k in want})
        before = shard.table.asked
        shard.insert(keys, [2] * 1000, list(range(batch, batch + 1000)))
        for k, first in zip(keys, range(batch, batch + 1000), strict=True):
            n, least = want.get(k, (0, first))
            want[k] = (n + 2, min(least, first))
        assert met <= shard.table.asked - before <= met + 10  # only what the filter knows is looked up
    assert dict(shard.table) == want and shard.filter.contains(shard.marks(list(want))).all()


def test_toxicity_hidden_words():
    plain = "you are an idiot and a moron but he said that this is all she can do with it of the more in the night at noon ".split()
    rng = random.Random(3)
    raw = np.frombuffer(" ".join(rng.choice(plain) for _ in range(20000)).encode(), np.uint8)
    lm = toxicity.Language.of(toxicity.gram_counts(raw, np.array([0, len(raw)])))
    for hidden, want in [("i d i o t", "idiot"), ("i  d  i  o  t", "idiot"), ("i. d. i. o. t", "idiot"), ("mor-on", "moron"), ("id iot", "idiot"), ("i dio t", "idiot"), ("morron", "moron"), ("idiiot", "idiot"), ("m0r on", "moron"), ("1d10t", "idiot")]:
        text = f"she said {hidden} at night"
        assert toxicity.suspects([text], lm).all(), hidden
        assert want in toxicity.Restorer(lm)(text).split(), hidden
    signs = "abdeimnorst" * 3 + "0134@$!|+(" + " .-_*" * 3 + "\né!#"
    texts = [*["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(4000)], *[" ".join(rng.choices(plain, k=4)) for _ in range(2000)]]
    flags, restore = toxicity.suspects(texts, lm), toxicity.Restorer(lm)
    assert 0 < flags.sum() < len(texts)
    assert [t for t, flag in zip(texts, flags, strict=True) if not flag and restore(t) != t] == []


def test_chat_format(spark):
    t = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "é!"), (2, 0, "system", "x"), (None, 0, "ann", "q"), (3, None, None, "z"), (3, 0, "bob", "b"), (3, 0, "bob", "b")]
    df = spark.createDataFrame(t, "conv_id long, turn long, role string, text string")
    got = chat_format.rotate(df)
    assert got.count() == 2 + 1 + 4  # bob's and unknown's views of both segments of 3, as its null turn has one of its own
    r = got.filter("conv_id = 1 and perspective = 'ann'").first()
    assert r["rendered"] == "<|system|>\nS<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n<|assistant|>\né!<|end|>\n"
    assert [r["rendered"][a:b] for a, b in r["mask"]] == ["hi<|end|>", "é!<|end|>"]
    for r in got.collect():
        assert all(r["rendered"][:a].endswith("<|assistant|>\n") for a, _ in r["mask"])
    long = spark.createDataFrame([(1, i, "ab"[i % 2], str(i)) for i in range(1000)] + [(1, 5, "a", str(i)) for i in range(900)], "conv_id long, turn long, role string, text string")
    x = chat_format.rotate(long).cache()
    assert x.groupBy("perspective").sum("n_turns").collect()[0][1] == 1900 and x.selectExpr("max(n_turns)").first()[0] < 2 * chat_format.TURNS
    assert chat_format.rotate(df.limit(0)).count() == 0


def test_chat_format_sparse_and_crowded(spark):
    said = [(1, 0, "system", "S"), *[(1, 10 * (i + 1), "ab"[i % 2], f"t{i:04}") for i in range(600)], *[(2, None, "ab"[i % 2], f"t{i:04}") for i in range(600)]]
    got = chat_format.rotate(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).filter("perspective = 'a'").collect()
    sparse = {r["segment"]: r for r in got if r["conv_id"] == 1}
    assert {k: r["n_turns"] for k, r in sparse.items()} == {0: 256, 1: 256, 2: 89}
    assert all(r["rendered"].startswith("<|system|>\nS<|end|>\n") for r in sparse.values())
    assert [t for k in range(3) for t in re.findall("t[0-9]{4}", sparse[k]["rendered"])] == [f"t{i:04}" for i in range(600)]
    assert all(r["rendered"][a:b].endswith("<|end|>") and r["rendered"][:a].endswith("<|assistant|>\n") for r in sparse.values() for a, b in r["mask"])
    crowded = {r["segment"]: re.findall("t[0-9]{4}", r["rendered"]) for r in got if r["conv_id"] == 2}
    assert [t for k in (-1, -2, -3) for t in crowded[k]] == [f"t{i:04}" for i in (*range(0, 600, 2), *range(1, 600, 2))]


def test_very_long_texts(spark):
    rng = random.Random(5)
    long = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(120_000))
    df = spark.createDataFrame([(1, long), (2, "x " + long[1000:]), (3, "z")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(df).collect()} == {1: 1, 2: 1, 3: 3}
    got = rows(suffix_dedup.dedup(df))
    assert got[2]["n_removed"] == len(long) - 1000 and bytes(got[2]["kept"]) == b"x "
    assert rows(line_dedup.kept(df, line_dedup.build(df)))[1]["n_lines"] == 1


def test_written_tables_are_shared(spark):
    x = common.written(spark.range(3).toDF("n"), "t")
    assert x.count() == 3 and x.written_to.startswith(common.shared_dir(spark))
    common.unwrite(x)


def test_toxicity_word_evidence(spark):
    said = ["the worthless idiot met a committee in disgust at the trash", "worthless committee coffee trash", "all is well"] * 200
    docs = spark.createDataFrame([*enumerate(said), (9000, "worthless Worthless"), (9001, None), (9002, "idioté id1ot")], "doc_id long, text string")
    lm = toxicity.language(docs)
    plain = collections.Counter(w for t in [*said, "worthless worthless", "idioté id1ot"] for w in re.findall(r"[a-zé]+", t))
    assert lm.total == sum(plain.values())
    assert {w: lm.count(w) for w in plain} == {w: n if n >= toxicity.LEAST else 0 for w, n in plain.items()} and lm.count("worthles") == 0
    read = toxicity.Restorer(lm)
    for w in ("worthless", "committee", "coffee", "all", "well"):
        assert read(w).strip() == w
    for hidden, want in [("w0rthless", "worthless"), ("worthlessss", "worthless"), ("idiiot", "idiot"), ("1d10t", "idiot"), ("c0ffee", "coffee"), ("tr@@sh", "trash")]:
        assert read(hidden).strip() == want, hidden
    assert read("worthless committee in disgust") == " worthless   committee  in disgust"
    long = "worthless coffee " * 400_000
    raw = np.frombuffer(long.encode(), np.uint8)
    keys, ns = toxicity.added(list(toxicity.word_blocks(raw, np.array([0, len(raw)]))))
    assert dict(zip(keys.tolist(), ns.tolist(), strict=True)) == {toxicity.word_key("worthless"): 400_000, toxicity.word_key("coffee"): 400_000}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_toxicity_finds_what_was_planted(spark):
    """Of the labelled toxic texts that hold a word which mostly toxic texts hold, at least 0.95 are found; of the others at most 0.01 are called toxic."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    rows_ = docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect()
    bags = {r["doc_id"]: set(re.findall(r"[a-z]+", (r["text"] or "").lower())) for r in rows_}
    in_toxic = collections.Counter(w for r in rows_ if r["toxic"] for w in bags[r["doc_id"]])
    in_clean = collections.Counter(w for r in rows_ if not r["toxic"] for w in bags[r["doc_id"]])
    told = {w for w, n in in_toxic.items() if n >= 4 and in_clean[w] == 0 and len(w) >= 4}
    toxic = [r["doc_id"] for r in rows_ if r["toxic"] and bags[r["doc_id"]] & told]
    clean = [r["doc_id"] for r in rows_ if not r["toxic"]]
    assert len(toxic) >= 15 and sum(got[i] for i in toxic) >= 0.95 * len(toxic)
    assert sum(got[i] for i in clean) <= 0.01 * len(clean)
