"""Queries against their SQL, and what their plans must not do, on small tables made for one fault each."""

import pytest

from tests.test_r03 import against_sql
from weftline.operators import matching


@pytest.mark.parametrize("names", [range(1, 401), [3, 3, 3, 6, None]])
def test_ticker_pairs_equal_their_sql_row_by_row(spark, tmp_path, names):
    got, want = against_sql(
        spark, "ticker_pairs", tmp_path, supplier=([(k,) for k in names], "s_suppkey long"), customer=([(k,) for k in [None, *range(1, 901), 103]], "c_custkey long"))
    assert got == want and len(got) > len(set(got))


def test_ticker_pairs_are_dealt_before_they_are_made(spark):
    """All names and rows have one ticker: no task makes most of the pairs, and nothing is done to them after the join."""
    left = spark.range(40).selectExpr("id AS l_id", "concat('T', id div 1000) AS l_upper")
    right = spark.range(2000).selectExpr("id AS r_id", "concat('t', id div 10000) AS ticker")
    pairs = matching.ticker_candidates(left, right, "l_id", "r_id")
    sizes = pairs.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 80_000 and max(sizes) < 40_000
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Broadcast" not in plan


def test_taxonomy_scores_see_the_ends_of_texts(spark, tmp_path):
    long = "a word " * 3000
    rows = [(1, long + "copyright", "s"), (2, "copyright " + long, "s"), (3, long + "the x und y", "s"), (4, long, "s"), (5, long + "idiot", "s"), (6, None, "licensed under")]
    got, want = against_sql(spark, "taxonomy_scores", tmp_path, documents=(rows, "doc_id long, text string, source string"))
    assert got == want and {(1, 5, "Home", "Legal", 12), (3, 6, "Trade", "Mixed", 4), (5, 0, "Home", "General", -9)} <= set(got)
