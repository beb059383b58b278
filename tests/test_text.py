"""Scalar functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import schema
from weftline.functions import text as X

RETAIL, LEGAL = ["official store", "official", "online store", "store", "shop"], ["inc", "llc", "ltd", "limited", "co", "company", "corp", "plc"]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    ("name", "a", "b"),
    [
        ("Oak & Lamp Official Store", "oakandlampofficialstore", "oakandlamp"), ("Tidal Works Inc", "tidalworksinc", "tidalworks"), ("TidalWorksInc", "tidalworksinc", "tidalworksinc"),
        ("Café Lune™", "caflune", "caflune"), ("Shoptown Shop Co. Ltd", "shoptownshopcoltd", "shoptown"), (None, "", ""), ("", "", ""),
    ],
)
def test_keys(spark, name, a, b):
    assert one(spark, name, X.key_squashed) == a
    assert one(spark, name, lambda c: X.key_trimmed(c, RETAIL, LEGAL)) == b


@pytest.mark.parametrize(("text", "truth"), [("TRUE", True), ("1", True), ("y", True), ("1.0", False), ("", False), (None, False)])
def test_truthy(spark, text, truth):
    assert one(spark, text, X.truthy) is truth


@pytest.mark.parametrize(
    ("phrase", "text", "n"),
    [("lamp", "red lamps, lamp; lamp-shade clamp", 2), ("hi-fi", "hi-fi hi-fidelity", 2), ("v1.5", "v1.5 v15", 1), ("oak desk", "oak desk oak desks", 2)],
)
def test_phrase_count(spark, phrase, text, n):
    assert one(spark, text, lambda c: X.phrase_count(c, phrase)) == n


def test_sets_and_urls(spark):
    assert one(spark, "b; A|a, x;b", lambda c: F.array_join(X.unique_items(X.split_items(c)), "; ")) == "b; A; x"
    assert one(spark, "https://WWW.Example.com:80/stores/oak?x=1", X.domain) == "example.com:80"
    assert one(spark, "shop.example.com/x", X.domain) == "shop.example.com"
    assert one(spark, "https://e.com/stores/oak?x=1", X.slug) == "oak"
    assert one(spark, "https://r.e/?a=1&url=https%3A%2F%2Fx.y%2F", X.redirect_target) == "https://x.y/"
    assert one(spark, None, X.domain) == ""
    assert one(spark, "TidalWorksUK24h", X.spaced_name) == "Tidal Works UK 24 h"
    assert one(spark, "  brk.b ", X.ticker) == "BRK-B"
    assert one(spark, "Continue to  Oak", X.clean_link_text) == "Oak"


def test_dates(spark):
    assert [str(one(spark, t, X.parse_date)) for t in ("2021-03-05", "2021/3/5", "x", None)] == ["2021-03-05", "2021-03-05", "None", "None"]
    assert one(spark, "2021-03-05", lambda c: X.display_date(X.parse_date(c))) == "2021/3/5"
    assert one(spark, "2021-08-05", lambda c: X.quarter_label(X.parse_date(c))) == "2021Q3"
    with pytest.raises(Exception, match="not a date"):
        one(spark, "soon", X.parse_date_strict)


def test_rules_cards_and_guards(spark):
    assert one(spark, "red ring", lambda c: X.first_rule(c, [("a", ["ring"]), ("b", ["red"])], "z")) == "a"
    assert one(spark, "blue", lambda c: X.first_rule(c, [("a", ["ring"])], "z")) == "z"
    assert tuple(one(spark, " A \n\n B\nc\nd", X.card_fields)) == ("A", "B", "c - d")
    assert [one(spark, t, X.guarded) for t in ("=1", "-x", "ok", None)] == ["'=1", "'-x", "ok", None]


def test_binding(spark):
    df = schema.tidy_headers(spark.createDataFrame([("Oak", "1")], ["Company Name ", "page-no"]))
    got = schema.bind(df, [schema.Field("name", ("merchant", "company_name"), required=True), schema.Field("page", ("page_no",), "int"), schema.Field("url", ("href",), default="")])
    assert got.collect() == [("Oak", 1, "")]
    with pytest.raises(ValueError, match="none of"):
        schema.bind(df, [schema.Field("x", ("y",), required=True)])
