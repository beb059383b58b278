"""Brands: keys from any of a row's names, and what an override changes."""

from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import brands

FIELDS = ("broad", "sub", "confidence", "reason", "needs_review")
SHOE = ("Sports & Outdoor", "Athletic footwear & apparel")


def test_brands(spark):
    rows = [
        (1, "NIKE", None, "Apparel & Fashion", "Footwear", "low", "two terms", True), (2, "Nike!", "", *SHOE, "high", "page", False), (3, "Nike", "x", *SHOE, "high", "page", True),
        (4, "Oak", "The LEGO", "", None, None, None, None), (5, "Oak", None, "Home", "Beds", "low", None, True), (6, None, None, "Home", "Beds", "low", "r", False), (7, "Booking.com", "", "Home", "Beds", "medium", "r", False),
    ]
    df = spark.createDataFrame(rows, "id int, name string, other string, broad string, sub string, confidence string, reason string, needs_review boolean")
    got = {r["id"]: r for r in df.select("id", brands.brand_key(F.col("name"), F.col("other")).alias("key"), brands.overridden({c: F.col(c) for c in FIELDS}, F.col("name"), F.col("other")).alias("o")).collect()}
    assert [got[k]["key"] for k in range(1, 8)] == ["nike", "nike", "nike", "thelego", None, None, "bookingcom"]
    assert tuple(got[1]["o"]) == (*SHOE, "high", "exact brand nike; before: Apparel & Fashion / Footwear / low; two terms", False)
    assert tuple(got[2]["o"]) == (*SHOE, "high", "page", False)
    assert got[3]["o"]["needs_review"] is False and got[3]["o"]["reason"].startswith("exact brand nike")
    assert tuple(got[4]["o"])[:3] == ("Baby & Kids", "Toys", "high") and got[4]["o"]["reason"] == "exact brand thelego; before: ; "
    assert tuple(got[5]["o"]) == ("Home", "Beds", "low", None, True) and tuple(got[6]["o"]) == ("Home", "Beds", "low", "r", False)
    assert got[7]["o"]["sub"] == "Travel booking / lodging marketplace"


def test_names(spark):
    ask = ["L.L.Bean", "TheLEGO", "AcademySports+Outdoors", "RedOak7.com", None]
    out = spark.createDataFrame([(n,) for n in ask], "n string").select(X.friendly_name(F.col("n"), brands.NAMES).alias("n")).collect()
    assert [r["n"] for r in out] == ["L.L.Bean", "LEGO", "Academy Sports Outdoors", "Red Oak 7", ""]
    assert len(brands.BRANDS) == 29
