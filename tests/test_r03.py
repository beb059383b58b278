"""Queries against their SQL on small tables made for one fault each."""

import random
import weakref

import duckdb
import numpy as np
import pyarrow as pa

import __spark_entry__ as e
from weftline.llm import common, jaccard_join
from weftline.operators import evidence


def against_sql(spark, name, folder, **tables):
    """The rows of a query and of its SQL over some tables, sorted."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = e.queries()[name](spark, str(folder))
    got = sorted((tuple(r) for r in df.collect()), key=str)
    return got, sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({e.oracle_sql()[name]})").fetchall(), key=str)


def test_a_number_in_two_names_makes_no_ticker_pair(spark, tmp_path):
    got, want = against_sql(
        spark, "ticker_pairs", tmp_path, supplier=([(k,) for k in range(1, 31)], "s_suppkey long"), customer=([(k,) for k in range(1, 131)], "c_custkey long"))
    assert got == want and (3, 103) in got and (11, 11) not in got


def test_a_reference_without_its_semicolon_stays_as_it_is(spark, tmp_path):
    html = '<title>A&amp;&amp;B &quot;C&quot; und&amp</title><h1>A&ampersand; &copy &am</h1><ul><li><a href="/x?a=1&copy=2&amp;b=3">Li&ampnk &quot</a></li></ul>'
    got, want = against_sql(spark, "page_evidence", tmp_path, pages=([(1, "https://h.example.com/p", html), (2, "https://h.example.com/p", "<title>&amp</title>")], "page_id long, url string, html string"))
    assert got == want and got[0][1] == 'A&&B "C" und&amp'


def test_references_in_parsed_pages():
    html = "<title>a&amp b&eacute;&#233;&#xe9; &noSuch;</title><script type='application/ld+json'>{\"name\": \"R&amp D\"}</script><a href='/shop?x&amp=1'>&ltx</a>"
    got = evidence.parse(html, "https://h.x/", closed=True)
    assert (got["title"], got["schema_text"], got["anchors"]) == ("a&amp bééé &noSuch;", "R&amp D", [{"text": "&ltx", "href": "https://h.x/shop?x&amp=1"}])
    assert evidence.parse("<title>a&amp</title>", "")["title"] == "a&"


def test_large_regions_make_no_loose_component_of_unlike_texts(spark, monkeypatch):
    rng = random.Random(3)
    words = lambda n: " ".join(str(rng.randrange(10**9)) for _ in range(n))
    common_ = "this line is at the head of every text that is here"
    texts = [f"{common_} {words(n)}" for n in [8] * 60 + [9] * 30 + [20, 40] * 20]
    texts += [t + " end" for t in texts[:10]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    least = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 100 * len(plain[a] & plain[b]) >= 75 * len(plain[a] | plain[b]):
                least[b] = min(least[b], least[a])
    for small, block in ((128, 1024), (2, 1024), (2, 7)):
        monkeypatch.setattr(jaccard_join, "SMALL", small)
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        got = dict(jaccard_join.jaccard_components(docs).select("doc_id", "component_id").collect())
        assert [got[k] for k in range(len(texts))] == least
    loose = jaccard_join.loose_components(jaccard_join.signatures(docs, "doc_id", "text"))
    assert loose.groupBy("label").count().agg({"count": "max"}).first()[0] < 60


def test_texts_far_from_all_pivots_make_one_region(spark, monkeypatch):
    rng = np.random.default_rng(5)
    own = [np.sort(rng.integers(0, 1 << 62, 40).astype(np.uint64)) for _ in range(300)]
    monkeypatch.setattr(jaccard_join, "MOST_SHINGLES", 2000)
    rows, written = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name: (out := written(df, name), rows.append((name, out.count())))[0])
    big = spark.createDataFrame([(1, k, bytearray(x.tobytes())) for k, x in enumerate(own)], "label long, node long, shingles binary")
    assert jaccard_join._divide(big).count() == 0
    assert dict(rows)["cells"] <= 2 * len(own)


def test_few_parsed_pages_are_python_objects_at_a_time(monkeypatch):
    alive, most, parse = weakref.WeakSet(), [0], evidence.parse

    class Row(dict):
        __hash__ = object.__hash__

    def one(*args):
        row = Row(parse(*args))
        alive.add(row)
        most[0] = max(most[0], len(alive))
        return row

    monkeypatch.setattr(evidence, "parse", one)
    n = 5 * evidence.AT_ONCE + 1
    got = evidence.parsed(pa.array([f"<title>{k}</title>" for k in range(n - 1)] + [None]), pa.array([None] * n, pa.string()))
    assert got.field("title").to_pylist() == [*map(str, range(n - 1)), ""] and most[0] <= 2 * evidence.AT_ONCE
