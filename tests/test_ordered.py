"""Joined lines against a plain version, and a key of very many lines."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import ordered


@pytest.mark.parametrize("cap", [None, 7])
def test_joined(spark, cap):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.choice([1, 2, None]), k, rng.choice(["x", "", "né", None])) for k in range(300)] + [("empty", 1, 0, None), ("first", 1, 0, ""), ("first", 2, 0, "z")]
    df = spark.createDataFrame(rows, "key string, o long, p long, line string").repartition(4)
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want[key] = "|".join(r[3] for r in own if r[3] is not None)[:cap]
    assert {r["key"]: r["t"] for r in ordered.joined(df, "key", ["o", F.col("p")], F.col("line"), "t", "|", cap).collect()} == want
    assert ordered.joined(df.limit(0), "key", ["o"], F.col("line"), "t").count() == 0


def test_a_key_of_many_lines(spark):
    """Half a million lines of one key, of which the first hundred characters are asked for, and all of them."""
    df = spark.range(500_000).select(F.lit(7).alias("key"), (-F.col("id")).alias("o"), F.col("id").cast("string").alias("line"))
    r = ordered.joined(df, "key", ["o"], F.col("line"), "t", " ", 100).collect()
    assert len(r) == 1 and r[0]["t"] == " ".join(str(k) for k in range(499_999, 499_900, -1))[:100]
    assert ordered.joined(df, "key", ["o"], F.col("line"), "t").select(F.length("t")).first()[0] == len(" ".join(map(str, range(500_000))))
