"""Landed records, page evidence, search, overrides, sinks and the whole taxonomy, on small fixtures."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import schema
from weftline.functions import text as X
from weftline.operators import dedupe, entities, evidence, facts, labels, matching, panel, providers, records, taxonomy
from weftline.sources import bundle
from weftline.streaming import resume


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://r.e/?u=%zz&url=%zz", ""), ("https://r.e/?target=https%3A%2F%2Fa.b%2F%zz&x=1", "https://a.b/%zz"), ("https://r.e/?url=x&dest_url=https%3A%2F%2Fa.b%2F%2520c", "https://a.b/ c"),
        ("https://r.e/?url=ftp://x&merchant_url=http://m.n/?a+b", "http://m.n/?a b"), (None, ""), ("", ""), ("https://r.e/#url=http://x.y", ""), ("https://r.e/?u=http%3A%2F%2Fx.y", ""),
    ],
)
def test_redirects(spark, url, want):
    assert one(spark, url, X.redirect_target) == want


def test_names_and_domains(spark):
    assert one(spark, "Crate&Barrel.COM", X.friendly_name) == "Crate and Barrel"
    assert one(spark, "B&HPhoto", lambda c: X.friendly_name(c, {"B&HPhoto": "B&H Photo"})) == "B&H Photo"
    assert one(spark, None, X.friendly_name) == ""
    assert one(spark, "UK;USA, Canada(Fr)|canada", lambda c: F.array_join(X.country_items(c), "; ")) == "United Kingdom; United States; Canada"
    assert [one(spark, c, X.country_hint) for c in ("The United Kingdom", "united states", "UnitedKingdom", None)] == [" UK", " US", "", ""]
    assert [one(spark, u, X.last_slug) for u in ("https://a.b/en-us/stores/nike/?x", "https://a.b/stores/nike", "/en/stores/x", "https://a.b/en-us/stores")] == ["nike", "", "x", ""]
    score = lambda n, u: spark.createDataFrame([(n, u)], "n string, u string").select(X.domain_score(F.col("n"), F.col("u"), ["official", "shop"], ["inc"]).alias("s")).first()["s"]
    assert [score("Nike Inc", "https://www.nike.com"), score("Nike", "https://shop.nike.com/x"), score("Nike Air", "https://nike.com"), score("Big Oak Co", "https://oakbigger.org"), score("", "https://nike.com"), score("Nike", "")] == [5, 4, 3, 2, 0, 0]
    assert one(spark, "a", lambda c: X.before_marker(F.concat(c, F.lit(" b  Manual: c")), "Manual:")) == "a b"
    assert one(spark, " ", lambda c: X.first_filled(c, F.lit(None).cast("string"), F.lit("x"))) == "x"
    assert one(spark, " ", lambda c: F.concat_ws("|", X.filled(c, fallback=F.lit("f")))) == "f"
    assert one(spark, "the lamp, the", lambda c: X.phrase_count(c, " The ")) == 2 and one(spark, "x", lambda c: X.phrase_count(c, "  ")) == 0


def test_pages_never_end_the_job(spark):
    deep = "<script type='application/ld+json'>" + "[" * 100000 + "]" * 100000 + "</script><title>T</title>"
    tree = "<script type='APPLICATION/LD+JSON'>" + '{"a":[' * 300 + '{"name":"deep","brand":{"name":"B"},"category":["c",1]}' + "]}" * 300 + "</script>"
    pages = [(1, deep, "https://h.x/"), (2, tree, "https://h.x/"), (3, None, None), (4, "<a href='http://[bad'>x</a><a href=' '>y</a><a>z</a><li>One<ul><li>Two</ul></li><svg><p>no</p></svg><h2></h2><h3>H</h3>", "https://www.h.x/"), (5, "<a href='/shop'>ab</a>", "http://[bad")]
    got = {r["id"]: r["evidence"] for r in evidence.with_evidence(spark.createDataFrame(pages, "id int, html string, url string"), blocked=["b."]).collect()}
    assert got[1]["title"] == "T" and got[2]["schema_text"] == "deep | c | B | B" and got[3]["body"] == ""
    assert got[4]["items"] == ["One Two", "Two"] and got[4]["anchors"] == [] and got[4]["headings"] == "H" and "no" not in got[4]["body"]
    assert got[5]["error"] == "ValueError"
    e = evidence.parse("<a href='https://www.h.x/Products/1'>in</a><a href='/about'>no</a><a href='https://b.com/'>blocked</a><a href='https://o.com/'>out</a>" + "<a href='/p'>" + "n" * 70 + "</a>" * 1 + "<a href='/q'>" + "m" * 80 + "</a>" * 90, "https://h.x/p", ["b."])
    assert e["internal_links"] == ["https://www.h.x/Products/1"] and e["external_links"] == ["https://o.com/"] and len(e["nav"]) <= 4000


def test_listings_count_once(spark):
    rows = [(1, "Nike", "https://zip.co/us/store/nike"), (2, "NIKE", "https://zip.co/us/store/nike"), (3, "Nike", "https://zip.co/us/store/NIKE"), (4, "Ni ke", "https://zip.co/us/store/nike"), (5, "...", "https://zip.co/us/store/dots"), (6, "a", "https://zip.co/us/store/a"), (7, "Z", "https://zip.co/us/store/directory/z")]
    df = spark.createDataFrame(rows, "o int, text string, href string")
    kept = lambda rules, **more: sorted(r["o"] for r in evidence.first_seen(evidence.listings(df, rules), "o", rules["seen"], **more).collect())
    assert kept(providers.ZIP) == [1]
    assert kept(providers.ZIP | {"seen": ["low", "link"]}) == [1, 4, 5]
    card = spark.createDataFrame([(1, "Nike\nSports\nKlarna at checkout", "https://x"), (2, "Show more", "https://www.klarna.com/us/store/")], "o int, text string, href string")
    assert [r["name"] for r in evidence.listings(card, providers.KLARNA).collect()] == ["Nike"]
    region = spark.createDataFrame([(1, "Australia", "https://www.afterpay.com/en-us/stores/au"), (2, "Oak", "https://www.afterpay.com/en-us/stores/a/b"), (3, "Oak", "https://www.afterpay.com/en-us/stores/oak")], "o int, text string, href string")
    assert [r["o"] for r in evidence.listings(region, providers.AFTERPAY).collect()] == [3]


def test_official_site_prefers_the_name(spark):
    r = [("k", 1, "x", "official", "https://x.org", "Nike"), ("k", 2, "Nike", "", "https://shop.nike.com", "Nike"), ("k", 3, "official shop", "", "https://facebook.com/nike", "Nike"), ("b", 1, "a store", None, "https://q.com", "")]
    df = spark.createDataFrame(r, "key string, rank int, title string, body string, href string, name string")
    got = {x["key"]: (x["href"], x["points"]) for x in evidence.official_site(df, "key", providers.BLOCKED_DOMAINS, providers.PROVIDER_DOMAINS, ["official"], ["inc"]).collect()}
    assert got == {"k": ("https://shop.nike.com", 4), "b": ("https://q.com", 1)}


def test_queries_and_reading_on(spark):
    df = spark.createDataFrame([("BigOak", "United States")], "n string, c string")
    q = df.select(evidence.search_queries(F.col("n"), X.friendly_name(F.col("n")), F.col("c"), {"bigoak": ["more"]}).alias("q")).first()["q"]
    assert q[0] == '"BigOak" official website store US' and q[5] == '"Big Oak" official website store US' and q[-1] == "more" and len(q) == 11
    known = spark.createDataFrame([("L.L.Bean",), ("The Pro's Closet Inc",), ("Hanna Andersson",), ("B&H Photo",), ("Oak",), (None,)], "n string")
    own = [r["q"] for r in known.select(F.filter(evidence.search_queries(F.col("n"), F.col("n"), F.lit("")), lambda x: F.array_contains(F.array(*[F.lit(v) for vs in evidence.SPECIAL.values() for v in vs]), x)).alias("q")).collect()]
    assert own == [['"L.L.Bean" outdoor clothing outdoor gear boots'], ['"The Pro\'s Closet" used bikes cycling marketplace'], evidence.SPECIAL["hannaandersson"], [], [], []]
    links = spark.createDataFrame([(["https://a/Login", "https://a/shop", "https://a/x?help", "https://a/c"],)], "l array<string>")
    assert links.select(evidence.worth_reading(F.col("l"), 2).alias("l")).first()["l"] == ["https://a/shop", "https://a/x?help"]


def test_choice_of_facts_by_accession(spark):
    rows = [("e", "10-K", "2022-01-01", a, t) for a, t in (("0001", 1), ("00012", 2), ("00012", 1), (None, 0))]
    df = spark.createDataFrame(rows, "entity string, form string, filed string, accn string, tag_ordinal int")
    assert facts.choose(df, ["entity"]).select("accn", "tag_ordinal").collect() == [("00012", 1)]


def test_last_rows_and_notes(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), ("a", "b", 3)], "k string, o string, v int")
    assert dedupe.keep_last(df, ["k"], "o").first()["v"] == 2
    many = spark.range(1500).select(F.lit("k").alias("key"), F.col("id").alias("ordinal"), F.lit("d").alias("date"), F.lit("p").alias("provider"))
    assert len(panel.notes(many, "key", F.col("ordinal").cast("string")).first()["note"].split(" | ")) == 1500


def test_records(spark):
    doc = '{"quotes": [{"symbol": "A", "longname": "Oak Inc"}, {"symbol": "A", "shortname": "OAK Corp", "quoteType": "equity"}, {"symbol": "F", "longname": "Oak ETF"}, {"quoteType": "ETF", "symbol": "G", "longname": "Elm"}, {"symbol": "", "longname": "x"}, {"symbol": "H"}]}'
    q = spark.createDataFrame([("k", 1, doc), ("k", 2, "{bad"), ("k", 3, None)], "k string, o int, d string")
    assert [(r["ticker"], r["name"], r["aliases"]) for r in records.quote_records(q, "k", "d", "o").collect()] == [("A", "OAK Corp", ["OAK Corp"])]
    e = '{"entities": {"Q1": {"labels": {"de": {"value": "Eiche"}}, "claims": {"P249": [{"mainsnak": {"datavalue": {"value": {"id": "Q9"}}}}, {"mainsnak": {}}, {"mainsnak": {"datavalue": {"value": "T"}}}]}}}}'
    x = records.entities(spark.createDataFrame([("Q1", e), ("Q2", e), ("Q3", None)], "q string, d string"), "q", "d")
    got = {r[0]: tuple(r)[1:] for r in x.select("q", records.label(F.col("entity")), records.claim_strings(F.col("entity"), "P249"), records.claim_ids(F.col("entity"), "P249")).collect()}
    assert got["Q1"] == ("Eiche", ["T"], ["Q9"]) and got["Q2"] == got["Q3"] == ("", [], [])
    assert [one(spark, n, records.non_operating) for n in ("Oak Fund", "Fundy Bay", "Bull 3x", "Oak", None)] == [True, True, True, False, False]


def test_aliases_and_domains_in_scores(spark):
    right = matching.variants(spark.createDataFrame([(1, "Zed", ["Oak Lamp", ""]), (2, "Oak", None)], "r_id int, r_name string, a array<string>"), "r_id", "r_name", "a")
    assert right.count() == 3
    right = matching.prepared(right, "r_name", records.LEGAL, records.GENERIC, "r_")
    left = matching.prepared(spark.createDataFrame([(7, "Oak Lamp", "https://oaklamp.com")], "l_id int, l_name string, url string"), "l_name", records.LEGAL, records.GENERIC, "l_")
    pairs = matching.candidates(left, right, "l_id", "variant").join(left, "l_id").join(right, "variant")
    got = {r["r_id"]: r["score"] for r in matching.best_of_variants(matching.score(pairs), "l_id", "r_id", matching.domain_bonus(F.col("l_key"), F.col("url"))).collect()}
    assert got[1] == 100.0 and 80 < got[2] < 100
    tickers = matching.prepared(spark.createDataFrame([(3, "Quite Other", "oak.l")], "r_id int, r_name string, ticker string"), "r_name", records.LEGAL, records.GENERIC, "r_")
    asks = matching.prepared(spark.createDataFrame([(8, "Oak.L"), (9, "OAK-L")], "l_id int, l_name string"), "l_name", [], [], "l_")
    assert matching.candidates(asks, tickers, "l_id", "r_id").collect() == [(8, 3)]


def test_overrides_switches_and_review(spark):
    rows = spark.createDataFrame([(1, "Oak Inc", "private", ""), (2, "oak", "", "x"), (3, "OAK", "direct_public", "Y"), (4, " ", "private", "")], "ordinal int, merchant_name string, listing_status string, needs_listing_review string")
    kept = labels.overrides(rows, "ordinal", records.LEGAL)
    assert [(r["merchant_key"], r["ordinal"]) for r in kept.collect()] == [("oak", 3)]
    r = kept.select(labels.override_result({c: F.col(c) for c in ("listing_status", "needs_listing_review", "merchant_key")}).alias("x")).first()["x"]
    assert (r["financial_data_available"], r["financial_data_level"], r["needs_review"], r["confidence"], r["score"]) == ("yes", "merchant_level", True, "manual", 0.0)
    over = spark.createDataFrame([("a", "A", 2, "x", "Z"), ("b", "B", 1, "Other / Unclassified", "My Zip"), ("c", "C", 1, "Other / Unclassified", "Else"), ("a", "A", 1, "Other / Unclassified", "zip")], "entity_key string, canonical_name string, provider_count int, broad_industry string, provider_set string")
    assert sorted((r["entity_key"], r["reason"]) for r in labels.review_queue(over, provider="Zip").collect()) == [("a", "overlap"), ("b", "single_unclassified")]


def test_sinks_and_landed_files(spark, tmp_path):
    df = spark.createDataFrame([("=1", 1, True), ("b", 2, None)], "v string, n int, f boolean")
    bundle.write_both(df, str(tmp_path / "t"))
    assert sorted(r["v"] for r in bundle.read(spark, str(tmp_path / "t.csv")).collect()) == ["'=1", "b"] and bundle.read(spark, str(tmp_path / "t.parquet")).count() == 2
    bundle.write_views(df, str(tmp_path / "v"), {"yes": F.col("f"), "no": ~F.col("f")})
    assert [n for n, _ in bundle.names(spark, str(tmp_path / "v"))] == ["all", "yes", "no"] and bundle.table(spark, str(tmp_path / "v"), "no").count() == 0
    for _ in range(2):
        bundle.append_log(df.coalesce(1), str(tmp_path / "log.csv"), ["n", "v"])
    log = bundle.read(spark, str(tmp_path / "log.csv"))
    assert log.columns == ["n", "v"] and log.count() == 4
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"x": 1}')
    (tmp_path / "in" / "b.json").write_text('{"x": 2}')
    assert bundle.landed(spark, str(tmp_path / "in"), 1).count() == 2 and bundle.landed(spark, str(tmp_path / "in"), 1, "2100-01-01 00:00:00").count() == 0
    parts = bundle.sections(spark, {"a": str(tmp_path / "in" / "a*.json"), "none": str(tmp_path / "in" / "z*.json")})
    assert [(r["section"], r["text"]) for r in parts.collect()] == [("a", '{"x": 1}')]
    with pytest.raises(FileNotFoundError):
        bundle.sections(spark, {"none": str(tmp_path / "z*")})
    assert bundle.newest(spark, str(tmp_path / "in" / "*.json")).endswith("b.json")
    (tmp_path / "o.csv").write_text("﻿ merchant_name ,listing_status\nOak,private\nOak,direct_public\n")
    assert [(r["ordinal"], r["merchant_name"]) for r in bundle.numbered(spark, str(tmp_path / "o.csv")).collect()] == [(0, "Oak"), (1, "Oak")]


@pytest.mark.parametrize(("multi_line", "most"), [(True, 100_000), (False, 100_000), (False, 2)])
def test_rows_are_numbered_where_they_are_read(spark, tmp_path, monkeypatch, multi_line, most):
    monkeypatch.setattr(bundle, "MOST_BLOCKS", most)
    want = []
    for name in ("c", "a", "d", "b"):
        said = [f"{name}{k}" for k in range({"a": 0, "b": 5, "c": 3000, "d": 1200}[name])]
        text = [f'"{x},\nmore ""of"" it"' if multi_line else f'"{x}, ""so"""' for x in said]
        (tmp_path / f"{name}.csv").write_text("\ufeff name ,n\n" + "".join(f"{t},{k}\n" for k, t in enumerate(text)))
        want.append((name, [(f'{x},\nmore "of" it' if multi_line else f'{x}, "so"', str(k)) for k, x in enumerate(said)]))
    rows = [r for _, part in sorted(want) for r in part]
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        spark.conf.set("spark.sql.files.openCostInBytes", "1024")
        df = bundle.numbered(spark, str(tmp_path / "*.csv"), multi_line=multi_line)
        assert df.columns == ["name", "n", "ordinal"]
        got = sorted((r["ordinal"], r["name"], r["n"]) for r in df.collect())
        parts = df.select(F.spark_partition_id()).distinct().count()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == [(i, *r) for i, r in enumerate(rows)]
    assert multi_line or parts > 1
    with pytest.raises(ValueError):
        bundle.numbered(spark, str(tmp_path / "*.csv"), "n")


def test_runs_forced_and_written_back(spark, tmp_path):
    from pyspark.sql import types as T

    s = T.StructType([T.StructField("key", T.StringType()), T.StructField("seq", T.LongType())])
    work = lambda df: df.select("key", F.col("ordinal").alias("seq"))
    for force, n in ((False, 1), (False, 1), (True, 5)):
        rows = spark.createDataFrame([("a", n)], "key string, ordinal long")
        got = resume.run(spark, rows, str(tmp_path / "s"), s, "key", work, force=force).collect()
    assert got == [("a", 5)]
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "n int, key string")
    back = resume.write_back(rows, spark.createDataFrame([("a", "done")], "key string, status string"), "key")
    assert sorted((r["n"], r["status"]) for r in back.collect()) == [(1, "done"), (2, "done"), (3, ""), (4, "")]
    assert [r["n"] for r in resume.rows_from(rows, "n", 1, 2).collect()] == [2, 3] and resume.rows_from(rows, "n", 3).count() == 1


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, 2)], "a int, premerge_b int")
    assert schema.backfill(df, {"a": 9, "c": "x"}).first()["c"] == "x" and schema.ordered(schema.backfill(df, {"c": 1}), ["c"]).columns == ["c", "a"]
    with pytest.raises(ValueError, match="missing"):
        schema.require(df, ["z"])


def test_taxonomy_of_full_size(spark):
    """As many terms and rules as a real taxonomy has, against plain counting."""
    rng = random.Random(6)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(500)]
    terms = [taxonomy.Term(f"B{k % 20}", f"S{k % 90}", rng.choice(vocab) if k % 2 else " ".join(rng.sample(vocab, 2)) if k % 3 else f"{rng.choice(vocab)}-{rng.choice(vocab)}") for k in range(708)]
    rails = [taxonomy.Guardrail(tuple(rng.sample(vocab, 3)), f"B{k % 20}", f"S{k % 90}", rng.randint(-9, 12), 1 + (k == 7)) for k in range(53)]
    texts = [(i, " ".join(rng.choices([*vocab, "-", "Zz"], k=rng.randint(0, 120))), " ".join(rng.choices(vocab, k=9))) for i in range(30)]
    got = {}
    for r in taxonomy.scores(spark.createDataFrame(texts, "id int, body string, nav string"), "id", {"body": 1, "nav": 5}, terms, rails).collect():
        got[r["id"], r["broad"], r["sub"]] = r["score"]
    want: dict = {}
    for i, body, nav in texts:
        for t in terms:
            for text, w in ((body, 1), (nav, 5)):
                p, low = t.term, " ".join(text.split()).lower()
                n = low.count(p) if re.search("[ '&-]", p) else len(re.findall(rf"(?<![a-z0-9]){re.escape(p)}(?![a-z0-9])", low))
                if n:
                    want[i, t.broad, t.sub] = want.get((i, t.broad, t.sub), 0) + n * w * taxonomy.bonus(p)
        for g in rails:
            if sum(p in f"{body} {nav}".lower()[:10000] for p in g.phrases) >= g.min_hits:
                want[i, g.broad, g.sub] = want.get((i, g.broad, g.sub), 0) + g.delta
    assert got == want and len(want) > 500


def test_sections_are_read_as_asked_and_as_they_land(spark, tmp_path):
    folders = {}
    for name in "abc":
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.json").write_text(f"{name}1\nsecond line")
        folders[name] = str(tmp_path / name)
    os.utime(tmp_path / "a" / "1.json", (0, 0))
    assert sorted(r["text"] for r in bundle.sections(spark, folders).collect()) == ["a1\nsecond line", "b1\nsecond line", "c1\nsecond line"]
    some = bundle.sections(spark, folders, {"a", "c"})
    assert sorted(os.path.basename(os.path.dirname(f)) for f in some.inputFiles()) == ["a", "c"]
    assert [r["section"] for r in bundle.sections(spark, folders, {"a", "b"}, max_age_days=1).collect()] == ["b"]
    for want in (["b1", "c1"], ["b2"], []):
        q = bundle.sections(spark, folders, {"b", "c"}, stream=True).select("section", "text").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        seen = sorted(r["text"][:2] for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert set(want) <= set(seen) and len(seen) == (2 if want == ["b1", "c1"] else 3)
        (tmp_path / "b" / "2.json").write_text("b2")


def test_entity_candidates(spark):
    def entity(label, ticker=None, aliases=(), parents=(), exchanges=(), site=None):
        claim = lambda *values: [{"mainsnak": {"datavalue": {"value": v}}} for v in values]
        return {"labels": {"en": {"value": label}}, "aliases": {"en": [{"value": a} for a in aliases]}, "claims": {
            "P249": claim(*([ticker] if ticker else [])), "P749": claim(*({"id": p} for p in parents)), "P414": claim(*({"id": x} for x in exchanges)), "P856": claim(*([site] if site else []))}}

    known = {"Q1": entity("Oak Lamp", "OAK", exchanges=["Q8", "Q99", "Q9", "Q8"], site="https://www.oak.example/"), "Q2": entity("Something Else", None, ["Oak Lamp"], ["Q1", "Q5", "Q1"]), "Q3": entity("Far Away", "FAR"),
             "Q5": entity("Parent", "PAR"), "Q8": entity("NYSE"), "Q9": entity("LSE"), "Q7": entity("Oak Lanp", "TYP")}
    docs = spark.createDataFrame([(q, json.dumps({"entities": {q: e}})) for q, e in known.items()] + [("Q77", "{}")], "qid string, doc string")
    found = records.entities(docs, "qid", "doc")
    search = lambda *ids: json.dumps({"search": [{"id": i} for i in ids]})
    rows = [(1, "Oak Lamp Inc", "", search("Q1", "", "Q2", "Q3")), (2, "Oak Lamp", "https://oak.example/x", search("Q7", "Q77", "Q1")), (3, "Nothing", "", search("Q3")), (4, None, "", None), (5, "x", "", "{broken")]
    asked = spark.createDataFrame(rows, "k int, name string, url string, doc string")
    hits = entities.search_hits(asked, "k", "doc")
    assert sorted((r["k"], r["rank"], r["id"]) for r in hits.collect()) == [(1, 0, "Q1"), (1, 2, "Q2"), (2, 0, "Q7"), (2, 1, "Q77"), (2, 2, "Q1"), (3, 0, "Q3")]
    got = entities.candidates(asked, hits, found, "k", "name", "url", "qid")
    assert sorted(map(tuple, got.select("k", "id", "via", F.round("score").cast("int"), "method", "exchange").collect())) == [
        (1, "Q1", "Q1", 100, "wikidata_direct_ticker", "NYSE; LSE"), (1, "Q1", "Q2", 100, "wikidata_public_parent", "NYSE; LSE"), (1, "Q5", "Q2", 100, "wikidata_public_parent", ""),
        (2, "Q1", "Q1", 100, "wikidata_direct_ticker", "NYSE; LSE"), (2, "Q7", "Q7", 88, "wikidata_direct_ticker", "")]
    assert sorted(map(tuple, entities.best_scores(got, "k").collect())) == [(1, 100.0, 100.0), (2, 100.0, None)]
    assert sorted((r["k"], r["id"]) for r in entities.first_of(got, "k", [F.col("ticker")]).collect()) == [(1, "Q1"), (2, "Q1")]
    assert entities.candidates(asked.limit(0), hits.limit(0), found, "k", "name", "url", "qid").count() == 0
