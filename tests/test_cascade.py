"""Decision cascades, case by case."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import cascade, evidence, matching, overlap
from weftline.streaming import resume


@pytest.mark.parametrize(
    ("name", "override", "direct", "firm", "entity", "parent", "want"),
    [
        ("", None, None, False, None, None, ("error", "low", True)),
        ("n", "private", 100.0, True, None, None, ("private", "manual", False)),
        ("n", None, 95.0, True, None, None, ("direct_public", "medium", True)),
        ("n", None, 97.0, True, None, None, ("direct_public", "high", False)),
        ("n", None, 97.0, False, None, None, ("direct_public_candidate_needs_review", "high", True)),
        ("n", None, 80.0, False, 93.0, None, ("direct_public_candidate_needs_review", "medium", True)),
        ("n", None, 80.0, False, 94.0, None, ("direct_public", "medium", False)),
        ("n", None, None, None, 80.0, 91.0, ("subsidiary_of_public", "medium", False)),
        ("n", None, None, None, 80.0, 89.0, ("subsidiary_public_candidate_needs_review", "medium", True)),
        ("n", "ambiguous", 99.0, True, None, None, ("ambiguous", "manual", True)),
        ("n", None, 76.0, False, None, None, ("ambiguous", "low", True)),
        ("n", None, None, None, None, None, ("no_public_match", "low", True)),
    ],
)
def test_listing_status(spark, name, override, direct, firm, entity, parent, want):
    df = spark.createDataFrame([(name, override, direct, firm, entity, parent)], "n string, o string, d double, f boolean, e double, p double")
    assert tuple(df.select(cascade.listing_status(*map(F.col, "nodfep")).alias("x")).first()["x"]) == want


def test_discovery(spark):
    df = spark.createDataFrame([("https://p.x/?url=https%3A%2F%2Fa.b%2F", "", None), ("https://p.x/s", "https://p.x/1| https://c.d/ ", None), ("https://p.x/s", "", "https://s.t/"), (None, None, None)], "u string, l string, s string")
    got = [tuple(r["x"]) for r in df.select(cascade.discover(F.col("u"), cascade.known_urls(F.col("l")), F.lit(None).cast("string"), F.col("s"), ["p.x"]).alias("x")).collect()]
    assert got == [("https://a.b/", "redirect"), ("https://c.d/", "existing"), ("https://s.t/", "search"), ("", "none")]


def test_parents(spark):
    df = spark.createDataFrame([(1, k, f"p{k}") for k in (5, 3, 1, 4, 2)] + [(2, 1, "q")], "entity long, ordinal long, parent string")
    assert sorted(cascade.parents(df).collect()) == [(1, "p1"), (1, "p2"), (1, "p3"), (1, "p4"), (2, "q")]


@pytest.mark.parametrize(
    ("switches", "want"),
    [
        ({}, ("direct_public", "high", False)),
        ({"quotes": False}, ("direct_public", "medium", False)),
        ({"offline": True}, ("no_public_match", "low", True)),
        ({"offline": True, "no_match_is_private": True}, ("private_no_public_match", "low", False)),
        ({"quotes": False, "entities": False}, ("no_public_match", "low", True)),
    ],
)
def test_switches(spark, switches, want):
    df = spark.createDataFrame([("n", None, 60.0, 97.0, True, 95.0, None)], "n string, o string, d double, q double, f boolean, e double, p double")
    assert tuple(df.select(resume.Switches(**switches).listing(*map(F.col, "nodqfep")).alias("x")).first()["x"]) == want


OTHER = "Other / Unclassified"


@pytest.mark.parametrize(
    ("row", "want"),
    [
        (("", "n", "u", True, True, OTHER, "low", OTHER, "low", OTHER, "low"), ("needs_manual_review", OTHER, "low", True)),
        (("", "n", "u", True, True, "A", "low", "B", "high", "C", "low"), ("official_website_verified", "A", "low", True)),
        (("", "n", "u", True, True, "A", "low", "B", "low", "C", "medium"), ("official_website_verified_plus_search_fallback", "C", "medium", False)),
        (("", "n", "u", True, True, OTHER, "high", "B", "low", "C", "low"), ("official_website_verified_plus_search_fallback", "C", "low", True)),
        (("", "n", " ", True, True, "A", "high", "B", "high", "C", "high"), ("search_only_no_official_url", "B", "high", False)),
        (("", "n", "u", None, True, "A", "high", OTHER, "low", "C", "high"), ("search_verified_website_unreachable", OTHER, "low", True)),
        (("", "n", "u", True, False, "A", "high", "B", "high", "C", "high"), ("website_parse_failed_search_fallback", "B", "high", True)),
        (("nav", None, "u", True, True, "A", "high", "B", "high", "C", "high"), ("exclude_non_merchant_page", "Exclude / Non-Merchant Page", "high", False)),
        (("", None, "u", True, True, "A", "high", "B", "high", "C", "high"), ("unable_to_verify", OTHER, "low", True)),
    ],
)
def test_classification(spark, row, want):
    df = spark.createDataFrame([row], "g string, n string, u string, f boolean, p boolean, a string, b string, c string, d string, e string, h string")
    got = df.select(cascade.classification(*map(F.col, "gnufp"), *((F.col(x), F.col(y)) for x, y in ("ab", "cd", "eh"))).alias("x")).first()["x"]
    assert tuple(got) == want


def test_blank_classifications_keep_the_first_row(spark):
    rows = [("k", 2, " ", "high", "official_website_verified", ""), ("k", 1, None, "low", "needs_manual_review", "TRUE"), ("m", 1, "A", "manual", "", ""), ("m", 2, "B", " Low ", "", "TRUE"), ("m", 3, "Exclude x", "high", "", "")]
    df = spark.createDataFrame(rows, "entity_key string, ordinal int, broad string, confidence string, status string, review string")
    assert sorted((r["entity_key"], r["ordinal"]) for r in overlap.best_classification(df).collect()) == [("k", 1), ("m", 2)]


def test_ticker_probe_compares_names(spark):
    ask = matching.prepared(spark.createDataFrame([(1, " brk.b "), (2, "A B"), (3, "ab"), (4, "longername")], "l_id int, l_name string"), "l_name", [], [], "l_")
    known = matching.prepared(spark.createDataFrame([(1, "X", "BRK.B"), (2, "Y", "ab"), (3, "Z", "longername"), (4, "W", None)], "r_id int, r_name string, ticker string"), "r_name", [], [], "r_")
    assert sorted(map(tuple, matching.candidates(ask, known, "l_id", "r_id").collect())) == [(1, 1), (3, 2)]


def test_a_description_is_tied_to_its_attribute():
    page = lambda *tags: evidence.parse("".join(f"<meta {t}>" for t in tags), "https://x")["description"]
    assert page('property="description" content="no"', 'name="description" content="yes"') == "yes"
    assert page('property="description" content="no"', 'property="og:description" content="og"', 'name="og:description" content="no"') == "og"
    assert page('name="description" content=""', 'name="twitter:description" content="t"') == "t"
