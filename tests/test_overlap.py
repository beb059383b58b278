"""Summaries of entities and their merging by aliases."""

import datetime

import pytest

from weftline.functions import text as X
from weftline.operators import overlap
from weftline.plans.tables import PROVIDERS

from .test_r03 import against_sql

SCHEMA = "entity_key string, canonical_name string, name_variants string, provider_count long, country_set string, urls string, files string, has_a int, has_b int"
ROWS = [
    ("k", "Bb", "Bb | B; b", 1, "USA; Peru", "u2 | u1", "f2", 0, 1),
    ("k", "Aaa", "aaa | BB", 2, "Peru;US", "u1", "f1; f2", 1, 0),
    ("k", "", None, 1, None, "", "", 0, 0),
    ("alone", "Al", "Al | al; AL , x y  z;;", 2, "UK|United Kingdom", "", None, 1, 1),
    ("single", "", "S", 1, "Chad", "u", "f", 0, 1),
    (None, "n1", "n1", 1, "Chad", "u", "f", 0, 1),
    (None, "n", "n;N1", 2, "chad", "u", "g", 1, 0),
]
WANT = {
    ("k", "Bb", 3, True, True, "a; b", 2, "none", "aaa; BB; B", "Peru; United States", "u1; u2", "f1; f2"),
    ("alone", "Al", 1, True, True, "a; b", 2, "", "Al; x y z", "United Kingdom", "", ""),
    ("single", None, 1, False, True, "b", 1, "", "S", "Chad", "u", "f"),
    (None, "n", 2, True, True, "a; b", 2, "", "n; N1", "chad", "u", "g; f"),
}


@pytest.mark.parametrize("few", [overlap.FEW, 0])
def test_merged_entities_work_their_rows_out_once(spark, monkeypatch, few):
    monkeypatch.setattr(overlap, "FEW", few)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    over = spark.createDataFrame(ROWS, SCHEMA).mapInArrow(count, SCHEMA)
    got = overlap.aggregate_flags(over, ["a", "b"], {"none": ["k"]})
    assert got.columns == ["entity_key", "canonical_name", "merged_rows", "has_a", "has_b", "providers", "provider_count", "exclusion", "name_variants", "countries", "urls", "files"]
    rows = {tuple(r) for r in overlap.in_order(got).collect()}
    assert seen.value == len(ROWS)
    assert rows == WANT


def test_merging_without_sets(spark):
    over = spark.createDataFrame(ROWS, SCHEMA).select("entity_key", "canonical_name", "has_a", "has_b")
    assert {tuple(r) for r in overlap.aggregate_flags(over, ["a", "b"], {"none": ["k"]}).collect()} == {r[:8] for r in WANT}


def test_summary_gathers_an_entitys_rows_once(spark):
    long = spark.createDataFrame(
        [("e", "Nn", "P", "c2", "x", "s", "u", "f"), ("e", "Nn", "P", "c1", "y", "", "", "f"), ("e", "n", "", "", "y", "s", None, None), ("e", "", None, None, "", "", "u", "g"), ("g", "G", None, "", " ", None, "", "")],
        "entity_key string, name string, provider string, country string, broad string, sub string, url string, file string")
    df = overlap.summary(long, ["P"])
    assert {tuple(r) for r in df.collect()} == {
        ("e", "n", "Nn | n", "P", 2, "c1; c2", "y", "s", "u", "f; g", 1), ("g", "G", "G", "", 0, "", "Other / Unclassified", "", "", "", 0)}
    plan = df.select("entity_key", "provider_count", "name_variants", "urls")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_collect_set(") <= 2 and plan.count("Exchange hashpartitioning") == 1


def test_alias_merged_query_on_odd_names(spark, tmp_path):
    names = ["A&B 10", "a&b\t10", " & ", "--", "", "x;X, y |z0", "x;X, y |z", "Z 0", "q R 20", "É 1", "lone"]
    day = datetime.datetime(1996, 5, 1)
    orders = [(i, i % len(names), "OFP"[i % 3], day + datetime.timedelta(days=100 * (i % 9)), f"{i % 5 + 1}-{PROVIDERS[i % 5]}") for i in range(160)]
    got, want = against_sql(
        spark, "overlap_alias_merged", tmp_path, customer=([(k, n, k % 3, "AUTO") for k, n in enumerate(names)], "c_custkey long, c_name string, c_nationkey long, c_mktsegment string"),
        nation=([(0, "PERU"), (1, "UNITED STATES"), (2, "peru")], "n_nationkey long, n_name string"),
        orders=(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"))
    assert len(got) == len(want) > 10
    assert [g for g, w in zip(got, want) if g != w] == []


def test_keys_and_what_has_one(spark):
    texts = ["A & B", "  &", "K", "İ", "Σ Σ", " a b", "--", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.key_squashed(X.F.col("t")).alias("k"), X.has_key(X.F.col("t")).alias("h"), X.alnum(X.F.replace(X.F.lower(X.squash(X.F.col("t"))), X.F.lit("&"), X.F.lit("and"))).alias("w"))
    rows = df.collect()
    assert [r["k"] for r in rows] == [r["w"] for r in rows]
    assert [bool(r["h"]) for r in rows] == [r["k"] != "" for r in rows]
