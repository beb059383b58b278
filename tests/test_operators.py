"""Operators on small fixtures, against plain Python."""

import os
import random
import shutil
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import similarity
from weftline.operators import dedupe, evidence, facts, matching, overlap, panel, regress, taxonomy
from weftline.sources import bundle
from weftline.streaming import resume


def test_modes_names_and_best(spark):
    df = spark.createDataFrame([("k", 1, "b", "OakLamp"), ("k", 2, "a", "oaklamp"), ("k", 3, "b", "OAKLAMP"), ("k", 4, "a", "")], "k string, o long, v string, n string")
    r = df.groupBy("k").agg(dedupe.modal(F.col("v")).alias("m"), dedupe.shortest_name("n").alias("n"), dedupe.sorted_set(F.col("n")).alias("s")).first()
    assert (r["m"], r["n"], r["s"]) == ("a", "OAKLAMP", "OAKLAMP; OakLamp; oaklamp")
    assert dedupe.keep_first(df, ["k"], "o").first()["o"] == 1
    assert dedupe.keep_last(df, ["k"], "o").first()["o"] == 4


@pytest.mark.parametrize("parts", [1, 5])
def test_order_of_rows_does_not_matter(spark, parts):
    rows = [(f"e{i % 7}", i, ";".join(random.Random(i).choices("aAbBcC", k=3))) for i in range(60)]
    want = {}
    for k, _, text in rows:
        seen = want.setdefault(k, [])
        for x in text.split(";"):
            if x.lower() not in [s.lower() for s in seen]:
                seen.append(x)
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o long, t string").repartition(parts)
    got = {r["k"]: r["items"].split("; ") for r in dedupe.joined_set(df, ["k"], F.split("t", ";"), "o", "items").collect()}
    assert got == want


def test_overlap_shares_and_matrix(spark):
    rows = [("e1", "A"), ("e1", "B"), ("e2", "A"), ("e3", "C")]
    m = {r["provider"]: r.asDict() for r in overlap.matrix(spark.createDataFrame(rows, "entity_key string, provider string"), ["A", "B", "C"]).collect()}
    assert m["A"]["b"] == m["B"]["a"] == 1 and m["A"]["a"] == 2 and m["C"]["a"] == 0
    s = overlap.shares(spark.createDataFrame([("x",), ("x",), ("",)], "v string"), "v").collect()
    assert sum(r["share"] for r in s) == pytest.approx(1)


def test_final_flags(spark):
    over = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "entity_key string, provider_count long")
    best = spark.createDataFrame([("a", "Home", "high", "FALSE"), ("b", "Other / Unclassified", "high", "FALSE")], "entity_key string, broad string, confidence string, review string")
    x = spark.createDataFrame([("b", "nav")], "entity_key string, kind string")
    got = {r["entity_key"]: r for r in overlap.final(over, best, x).collect()}
    assert got["a"]["is_high"] and not got["a"]["needs_review"]
    assert got["b"]["is_excluded"] and not got["b"]["needs_review"]
    assert got["c"]["merge_status"] == "left_only" and got["c"]["needs_review"] and not got["c"]["is_excluded"]


def test_taxonomy(spark):
    docs = spark.createDataFrame([(1, "oak desk oak desks", "lamp"), (2, "", ""), (3, None, "bad")], "id long, body string, nav string")
    terms = [taxonomy.Term("Home", "Desk", "oak desk"), taxonomy.Term("Home", "Light", "lamp")]
    rails = [taxonomy.Guardrail(("bad",), "Home", "Desk", -5)]
    plain = {(r["id"], r["sub"]): r["score"] for r in taxonomy.scores(docs, "id", {"body": 2, "nav": 5}, terms).collect()}
    assert plain == {(1, "Desk"): 2 * 3 * 2, (1, "Light"): 5}
    found = taxonomy.entries(docs, {"body": 2, "nav": 5}, terms, rails)
    got = {r["id"]: r for r in taxonomy.classify(found, "id", F.lit(True), F.lit(True), F.lit(False)).collect()}
    assert (got[1]["sub"], got[1]["margin"], got[1]["confidence"]) == ("Desk", 7, "low")
    assert got[2]["broad"] == got[3]["broad"] == "Other / Unclassified" and got[3]["review"]
    assert taxonomy.extend(terms, [terms[0], taxonomy.Term("Home", "Desk", "bureau")])[-1].term == "bureau"


def test_page_evidence():
    e = evidence.parse(
        "<title>A &amp; B</title><body><h1>One<h1>Two</h1><script>var x='no'</script><script type='application/ld+json'>{\"@type\":\"Shop\",\"x\":[{\"name\":\"N\"}]}</script>"
        "<meta property='og:description' content=' d  e '><a href='/in'>In side<a href='/Shop/x'>S<b>h</b></a><a href='https://o.x/'>Out</a>", "https://h.x/p")  # fmt: skip
    assert e["headings"] == "One | Two" and "no" not in e["body"] and e["description"] == "d e" and e["schema_text"] == "Shop | N"
    assert e["nav"] == "In side | S h | Out" and e["internal_links"] == ["https://h.x/Shop/x"] and e["external_links"] == ["https://o.x/"]
    assert evidence.parse(None, None)["title"] == ""


def test_ratio_and_score(spark):
    pairs = [("nike", "nike inc"), ("north trail", "trail north"), ("abcd", "bcde"), ("", "x")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.ratio("a", "b").alias("r"))
    for a, b, r in df.collect():
        assert r == pytest.approx(100 * SequenceMatcher(None, a, b).ratio() if a and b else 0)
    legal, generic = ["inc"], ["group"]
    left = matching.prepared(spark.createDataFrame([(1, "Oak Lamp")], "l_id long, l_name string"), "l_name", legal, generic, "l_")
    right = matching.prepared(spark.createDataFrame([(7, "Oak Lamp Inc"), (8, "Oak Tree Group"), (9, "Elm")], "r_id long, r_name string"), "r_name", legal, generic, "r_")
    got = matching.score(matching.candidates(left, right, "l_id", "r_id").join(left, "l_id").join(right, "r_id"))
    ranked = matching.top(got, "l_id", [F.col("r_id")])
    assert [(r["r_id"], r["score"]) for r in ranked.collect()][0] == (7, 100.0)
    d = matching.decide(ranked, "l_id").first()
    assert d["status"] == "direct_public" and not d["review"]


def test_fact_choice(spark):
    rows = [("e", "m", "CY2021Q4I", "10-K/A", "2022-05-01", "2", "t1", 1, 5.0), ("e", "m", "CY2021Q4I", "10-K", "2022-02-01", "1", "t1", 1, 4.0), ("e", "m", "CY2021Q4I", "10-K", "2022-03-01", "0", "t2", 2, 3.0),
            ("e", "flow", "CY2021Q4I", "10-K", "2022-03-01", "0", "t2", 2, 3.0), ("e", "m", None, "10-K", "2022-03-01", "0", "t2", 2, 9.0)]
    df = spark.createDataFrame(rows, "entity string, metric string, frame string, form string, filed string, accn string, tag string, tag_ordinal int, val double")
    q, a = facts.by_period(facts.usable(df), ["m"])
    assert {r["metric"]: r["val"] for r in facts.choose(q, ["entity", "metric", "year", "quarter"]).collect()} == {"m": 3.0, "flow": 3.0}
    assert [r["metric"] for r in facts.choose(a, ["entity", "metric", "year"]).collect()] == ["m"]


def test_company_facts(spark):
    doc = '{"facts": {"us-gaap": {"Revenue": {"units": {"USD": [{"val": 1.5, "frame": "CY2020", "form": "10-K", "filed": "2021", "accn": "a"}]}}}}}'
    got = facts.company_facts(spark.createDataFrame([("e", doc), ("f", "{"), ("g", None)], "e string, d string"), "e", "d").collect()
    assert [(r["e"], r["tag"], r["val"]) for r in got] == [("e", "Revenue", 1.5)]
    rec = facts.columnar_records(spark.createDataFrame([('{"fields": ["a", "b"], "data": [["1", "x"], ["2", null]]}',)], "d string"), "d").collect()
    assert [r["record"] for r in rec] == [{"a": "1", "b": "x"}, {"a": "2", "b": None}]


def test_panel(spark):
    rows = [("e", p, float(10 + p), 1.0, -5.0 if p == 1 else 10.0, 1.0, 2.0) for p in (1, 2, 4)] + [("z", 1, 0.0, 1.0, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "entity string, period long, revenue double, gross_profit double, operating_income double, net_income double, assets double")
    got = {(r["entity"], r["period"]): r for r in panel.outcomes(df, "entity", "period", 1).collect()}
    assert got["e", 4]["revenue_growth"] == pytest.approx(14 / 12 - 1) and got["e", 2]["operating_income_growth"] == 1.0
    assert got["z", 1]["gross_margin"] is None and got["z", 1]["log_revenue"] is None and got["e", 1]["revenue_growth"] is None
    calendar = {(r["entity"], r["period"]): r for r in panel.outcomes(df, "entity", "period", 1, calendar=True).collect()}
    assert calendar["e", 4]["revenue_growth"] is None and calendar["e", 2]["revenue_growth"] == pytest.approx(12 / 11 - 1)


@pytest.mark.parametrize("most_dense", [200, 0])
def test_twfe_against_dummies(spark, most_dense):
    rng = np.random.default_rng(4)
    rows = [(f"f{i}", t, int(t > 3 + i % 4), float(i + 0.3 * t + 0.5 * (t > 3 + i % 4) + rng.normal())) for i in range(12) for t in range(10) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "entity string, period long, post int, y double")
    r = regress.twfe(df, ["y"], "entity", "period", "post", most_dense).first()
    firms, times = sorted({x[0] for x in rows}), sorted({x[1] for x in rows})
    x = np.array([[1, p, *[e == f for f in firms[1:]], *[t == s for s in times[1:]]] for e, t, p, _ in rows], float)
    y = np.array([v[3] for v in rows])
    inv = np.linalg.pinv(x.T @ x)
    b = inv @ x.T @ y
    u, meat = y - x @ b, 0
    for f in firms:
        at = [k for k, v in enumerate(rows) if v[0] == f]
        s = x[at].T @ u[at]
        meat = meat + np.outer(s, s)
    n, k, g = len(y), x.shape[1], len(firms)
    se = np.sqrt((inv @ meat @ inv)[1, 1] * g / (g - 1) * (n - 1) / (n - k))
    assert (r["coef_post"], r["se_cluster"], r["nobs"], r["n_firms"]) == (pytest.approx(b[1], rel=1e-9), pytest.approx(se, rel=1e-9), n, g)
    few = regress.twfe(df.filter("entity in ('f1', 'f2')"), ["y"], "entity", "period", "post").first()
    assert few["status"] == "not_enough_variation"


def test_twfe_of_many_periods(spark):
    """More periods than a matrix is made for, gaps, repeated rows, and an outcome with two unconnected halves."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(30):
        for t in range(300):
            if rng.random() < 0.4:
                post = int(t > 80 + 7 * i)
                half = 1.0 * (i + t) if (i < 15) == (t < 150) else None
                rows += [(f"f{i}", t, post, float(i + 0.01 * t + 0.5 * post + rng.normal()), None if half is None else half + 2.0 * post + float(rng.normal()))] * int(rng.integers(1, 3))
    df = spark.createDataFrame(rows, "entity string, period long, post int, y double, z double").repartition(5)
    a, b = ({r["outcome"]: r for r in regress.twfe(df, ["y", "z"], "entity", "period", "post", most).collect()} for most in (200, 1000))
    for o in ("y", "z"):
        for c in ("coef_post", "se_cluster", "t_stat", "p_value"):
            assert a[o][c] == pytest.approx(b[o][c], rel=1e-8, abs=1e-12), (o, c)
        assert (a[o]["nobs"], a[o]["n_firms"], a[o]["status"]) == (b[o]["nobs"], b[o]["n_firms"], "ok")


def test_bundle_and_resume(spark, tmp_path):
    a, b = spark.createDataFrame([("=1",)], "v string"), spark.createDataFrame([(1,)], "n long")
    bundle.write({"summary": b, "data": a}, str(tmp_path / "w"))
    assert bundle.table(spark, str(tmp_path / "w")).first()["v"] == "'=1"
    assert bundle.table(spark, str(tmp_path / "w"), "summary").first()["n"] == 1
    assert bundle.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "w")]).endswith("w")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("out", T.LongType())])
    work = lambda df: df.select("key", F.col("ordinal").alias("seq"), (F.col("v") * 2).alias("out"))
    first = spark.createDataFrame([("a", 1, 10), ("a", 2, 11)], "key string, ordinal long, v long")
    store = str(tmp_path / "store")
    assert resume.run(spark, first, store, schema, "key", work).collect() == [("a", 1, 20)]
    (tmp_path / "store" / "part-bad.json").write_text("{broken\n")
    more = spark.createDataFrame([("a", 3, 99), ("b", 4, 5)], "key string, ordinal long, v long")
    assert sorted(resume.run(spark, more, store, schema, "key", work).collect()) == [("a", 1, 20), ("b", 4, 10)]


@pytest.fixture
def landing(spark, tmp_path):
    """A folder that rows land in, a store, and a way to run the stream over what is there."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("seq", T.LongType())])
    src = "key string, ordinal long"

    def land(*rows):
        spark.createDataFrame(rows, src).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    def go(work=lambda df: df.select("key", F.col("ordinal").alias("seq"))):
        q = resume.stream(spark.readStream.schema(src).json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), "key", schema, work)
        assert q.awaitTermination(120)

    def rows():
        return sorted((r["key"], r["seq"]) for r in spark.read.schema(schema).option("recursiveFileLookup", True).json(str(tmp_path / "out")).collect())

    return land, go, rows, schema, str(tmp_path / "out")


def test_stream_skips_what_is_done(spark, landing):
    land, go, rows, schema, out = landing
    spark.createDataFrame([("a", 7)], schema).write.json(out)  # done by a run in batch
    land(("a", 1), ("b", 3), ("b", 2), (None, 4))
    go()
    assert rows() == [("a", 7), ("b", 2)]
    for file in spark.read.schema(schema).option("recursiveFileLookup", True).json(out).inputFiles():
        os.remove(file.removeprefix("file://"))  # the store isn't read again: the state knows what is done
    land(("b", 9), ("c", 5), ("a", 0))
    go()
    assert rows() == [("c", 5)]


def test_stream_that_fails_doubles_nothing(spark, landing):
    land, go, rows, schema, out = landing
    land(("a", 1), ("b", 2))

    def breaks(df):
        df.select("key", F.col("ordinal").alias("seq")).write.mode("append").json(out + "/stream-part")
        raise ValueError("half way")

    with pytest.raises(Exception, match="half way"):
        go(breaks)
    shutil.rmtree(out)
    go()
    go()
    assert rows() == [("a", 1), ("b", 2)]


def test_compaction_keeps_the_last_row_of_a_key(spark, landing):
    *_, rows, schema, out = landing
    resume.compact(spark, out, schema, "key")
    for part in ([("a", 1), ("b", 2)], [("a", 3)]):
        spark.createDataFrame(part, schema).write.mode("append").json(out)
    want = sorted(map(tuple, resume.load(spark, out, schema, "key").collect()))
    resume.compact(spark, out, schema, "key")
    assert rows() == want == [("a", 3), ("b", 2)]


def test_bundles_are_written_whole_or_not_at_all(spark, tmp_path):
    path, n = str(tmp_path / "b"), spark.range(10).withColumn("v", F.lit("x"))
    seen = bundle.write({"one": n, "two": n.filter("id > 6").drop("v")}, path, metrics={"most": F.max("id"), "texts": F.count("v")})
    assert seen["one"] == {"rows": 10, "most": 9, "texts": 10} and seen["two"] == {"rows": 3, "most": 9}
    first = bundle.version(spark, path)
    assert sorted(map(tuple, bundle.seen(spark, path).filter("name = 'two'").collect())) == [("two", "most", "9"), ("two", "rows", "3")]
    breaks = n.withColumn("v", F.when(F.col("id") == 5, F.raise_error(F.lit("half way"))).otherwise("y"))
    with pytest.raises(Exception, match="half way"):
        bundle.write({"one": n.limit(1), "two": breaks}, path)
    assert bundle.version(spark, path) == first and bundle.table(spark, path, "one").count() == 10
    pinned = bundle.table(spark, path, "one", number=first)
    bundle.write({"three": n.limit(2)}, path, "csv")
    assert bundle.names(spark, path) == [("three", "csv")] and bundle.table(spark, path).count() == 2
    assert bundle.names(spark, path, first) == [("one", "parquet"), ("two", "parquet")] and pinned.count() == 10
    bundle.vacuum(spark, path, 1)
    assert bundle._numbers(spark, path) == [first + 1] and bundle.table(spark, path).count() == 2
    with pytest.raises(FileNotFoundError):
        bundle.version(spark, str(tmp_path / "none"))
