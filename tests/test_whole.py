"""Queries that must cover the whole of their tables, against plain SQL of the whole job."""

import json
import os

import duckdb
import pytest

from tests.test_entry import SF
from weftline.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def rows(sql: str) -> list[tuple]:
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return sorted(con.execute(sql).fetchall())


def test_event_panel_keeps_forty_quarters(spark):
    from weftline.plans.panel_queries import _EVENTS, _QUARTER

    got = catalog.queries()["event_panel"](spark, SF).select("entity", "period", "event_index").collect()
    panel = f"SELECT DISTINCT l_suppkey AS entity, {_QUARTER} AS period FROM lineitem"
    assert sorted(map(tuple, got)) == rows(f"WITH {_EVENTS} SELECT entity, period, event_index FROM ({panel}) JOIN events_ USING (entity) WHERE abs(period - event_index) <= 40")


def test_one_hop_owners_come_from_all_customers(spark):
    got = catalog.queries()["one_hop_owners"](spark, SF).collect()
    assert sorted(map(tuple, got)) == rows("SELECT s_suppkey, c_name FROM supplier JOIN customer ON s_nationkey = c_nationkey QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY c_custkey) <= 4")


def test_review_queue_takes_five_hundred(spark, monkeypatch):
    from weftline.plans import entity_queries

    singles = spark.range(600).selectExpr("concat('e', id) AS entity_key", "'n' AS canonical_name", "1L AS provider_count", "'MACHINERY' AS broad_industry")
    monkeypatch.setattr(entity_queries, "_summary", lambda *_: singles)
    assert entity_queries.review_queue(spark, SF).count() == 500


def test_candidate_json_lists_five(spark, monkeypatch):
    from weftline.plans import classify_queries

    ranked = spark.range(1, 9).selectExpr("1L AS l_id", "id AS r_id", "CAST(100 - id AS DOUBLE) AS score", "CAST(id AS INT) AS place")
    monkeypatch.setattr(classify_queries, "_native", lambda *_: ranked)
    (row,) = classify_queries.candidate_json(spark, SF).collect()
    assert [c["r_id"] for c in json.loads(row["candidates"])] == [1, 2, 3, 4, 5]


def test_listings_rules_of_providers(spark):
    from weftline.operators import evidence

    rows = [("Big Shop klarna at checkout", "https://k.x/a"), ("Nike", "https://k.x/us/store/nike"), ("Help", "https://k.x/us/store/help"), ("Nike", "https://k.x/b"), ("a", "https://z.x/us/store/a"),
            ("Zara", "https://www.z.x/us/store/zara/?q=1"), ("Zara", "https://y.x/us/store/zara"), ("Dir", "https://z.x/us/store/directory/a"), ("Root", "https://z.x/us/store/"), ("me@z.x", "https://z.x/us/store/m")]
    df = spark.createDataFrame(rows, "text string, href string")
    kept = lambda **rules: {(r["text"], r["href"]) for r in evidence.listings(df, {"blocked": ["help"], "longest": 100, "blocked_parts": [], **rules}).collect()}
    assert kept(path="/us/store/", signals=["klarna at checkout"]) == set(rows) - {rows[2], rows[3]}
    assert kept(hosts=["z.x", "www.z.x"], prefix="/us/store/", closed=["/us/store/directory"], single=False, plain=True) == {rows[5]}
