"""Queries over landed records, listings of providers, search results, samples and their audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import entities, evidence, facts, labels, matching, panel, providers, records
from ..streaming import resume
from . import panel_queries
from .classify_queries import RATIO_SQL
from .tables import read


def _s(c):
    return F.col(c).cast("string")


def exchange_records(spark, sf):
    row = F.concat(F.lit('[["'), _s("s_suppkey"), F.lit('", "'), "s_name", F.lit(' - Class A", "'), F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("T"), _s("s_suppkey"))).otherwise(""), F.lit('", "NYSE"]]'))
    doc = F.concat(F.lit('{"fields": ["cik", "name", "ticker", "exchange"], "data": '), row, F.lit("}"))
    return records.exchange_records(read(spark, sf, "supplier").select("s_suppkey", doc.alias("doc")), "doc", ["s_suppkey"]).drop("ordinal")


def _tickers(spark, sf):
    """One object for each nation, its suppliers keyed by number; tickers repeat over nations."""
    one = F.concat(F.lit('"'), _s("s_suppkey"), F.lit('": {"cik_str": '), _s("s_suppkey"), F.lit(', "ticker": "t'), (F.col("s_suppkey") % 40).cast("string"), F.lit('", "title": "'), "s_name", F.lit('"}'))
    docs = read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(one), ", "), F.lit("}")).alias("doc"))
    return records.ticker_map(docs, "doc")


def quote_records(spark, sf):
    k = F.col("s_suppkey")
    quotes = F.array(
        F.struct(F.when(k % 3 == 0, "etf").when(k % 3 == 1, "Equity").alias("quoteType"), F.concat(F.lit("S"), (k % 30).cast("string")).alias("symbol"), F.when(k % 4 != 0, F.concat("s_name", F.lit(" Inc"))).alias("longname"), F.lit("Short").alias("shortname"), F.lit("NYSE").alias("exchDisp")),
        F.struct(F.lit("EQUITY").alias("quoteType"), F.when(k % 7 != 0, "W").otherwise("").alias("symbol"), F.when(k % 2 == 0, "Oak Warrants").otherwise("Oak Inc").alias("longname"), _s("s_suppkey").alias("shortname"), F.lit("").alias("exchDisp")),
    )
    docs = read(spark, sf, "supplier").select("s_nationkey", "s_suppkey", F.to_json(F.struct(quotes.alias("quotes"))).alias("doc"))
    return records.quote_records(docs, "s_nationkey", "doc", "s_suppkey").select("s_nationkey", "ticker", "name", "exchange", F.array_join("aliases", "|").alias("aliases"))


def _claim(prop, *values):
    return F.concat(F.lit(f'"{prop}": ['), F.concat_ws(", ", *[F.concat(F.lit('{"mainsnak": {"datavalue": {"value": '), v, F.lit("}}}")) for v in values]), F.lit("]"))


def _entities(spark, sf):
    k = F.col("s_suppkey")
    q = lambda c: F.concat(F.lit('{"id": "Q'), c.cast("string"), F.lit('"}'))
    ticker = F.when(k % 3 == 0, F.concat(F.lit('"X'), k.cast("string"), F.lit('"'))).otherwise(F.lit("null"))
    lang = F.when(k % 4 == 0, "mul").when(k % 4 == 1, "de").otherwise("en")
    body = F.concat(
        F.lit('{"labels": {"'), lang, F.lit('": {"value": " '), "s_name", F.lit(' "}}, "aliases": {"mul": [{"value": "m"}], "en": [{"value": "e"}, {"value": ""}]}, "claims": {'), _claim("P249", ticker), F.lit(", "),
        _claim("P749", q((k * 7) % 100), q((k * 7) % 100)), F.lit(", "), _claim("P127", q((k * 3) % 100), F.lit('"text"')), F.lit(", "), _claim("P856", F.concat(F.lit('"https://www.s'), k.cast("string"), F.lit('.example/"'))), F.lit("}}"))
    qid = F.concat(F.lit("Q"), k.cast("string"))
    docs = read(spark, sf, "supplier").select(qid.alias("qid"), F.concat(F.lit('{"entities": {"'), qid, F.lit('": '), body, F.lit("}}")).alias("doc"))
    return records.entities(docs, "qid", "doc")


def entity_claims(spark, sf):
    e = F.col("entity")
    joined = lambda a: F.array_join(a, "|")
    return _entities(spark, sf).select("qid", records.label(e).alias("label"), joined(records.aliases(e)).alias("aliases"), joined(records.claim_strings(e, "P249")).alias("ticker"), joined(records.claim_ids(e, "P749")).alias("parents"), joined(records.claim_ids(e, "P127")).alias("owners"))


def entity_matches(spark, sf):
    k = F.col("c_custkey")
    hits = read(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("Q"), (k % 120).cast("string")).alias("qid"), (45 + (k * 37) % 60).cast("double").alias("score"), F.when(k % 2 == 0, F.concat(F.lit("https://s"), (k % 120).cast("string"), F.lit(".example/x"))).otherwise("").alias("url"))
    return records.entity_matches(hits, _entities(spark, sf), "c_custkey", "qid", "url")


def entity_candidates(spark, sf):
    """Customers' names asked of the landed entities of suppliers: their own name, another's, one that only sounds like it."""
    k = F.col("c_custkey")
    number = lambda c: F.lpad(c.cast("string"), 9, "0")
    name = F.when(k % 3 == 0, F.concat(F.lit("Supplier#"), number(k % 100 + 1))).when(k % 3 == 1, F.concat(F.lit("Supplier "), number((k * 7) % 100 + 1), F.lit(" Inc"))).otherwise(F.concat(F.lit("Suplier "), number(k % 100 + 1)))
    url = F.when(k % 2 == 0, F.concat(F.lit("https://s"), (k % 100 + 1).cast("string"), F.lit(".example/x"))).otherwise("")
    hit = lambda c: F.concat(F.lit('{"id": "Q'), c.cast("string"), F.lit('"}'))
    doc = F.concat(F.lit('{"search": ['), F.concat_ws(", ", hit(k % 100 + 1), F.lit('{"id": ""}'), hit((k * 7) % 110 + 1), hit(F.lit(1))), F.lit("]}"))
    asked = read(spark, sf, "customer").select("c_custkey", name.alias("asked"), url.alias("url"), doc.alias("doc"))
    x = entities.candidates(asked, entities.search_hits(asked, "c_custkey", "doc"), _entities(spark, sf), "c_custkey", "asked", "url", "qid")
    return x.withColumn("score", F.round("score", 4))


def market_ranks(spark, sf):
    k = F.col("s_suppkey")
    exchange = F.element_at(F.array(*map(F.lit, [" NYSE", "London", "Toronto", "Frankfurt", "SET", "Elsewhere"])), (k % 6 + 1).cast("int"))
    ticker = F.when(k % 2 == 0, F.concat(F.lit("A."), k.cast("string"))).otherwise("AB")
    c = read(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_name", exchange.alias("exchange"), ticker.alias("ticker"), (70 + k % 3).cast("double").alias("score"))
    return matching.top(c, "s_nationkey", [*matching.candidate_order(F.col("exchange"), F.col("ticker"), F.col("s_name")), F.col("s_suppkey")]).select("s_nationkey", "s_suppkey", "place", records.market_rank(F.col("exchange"), F.col("ticker")).cast("long").alias("market"))


def alias_scores(spark, sf):
    """Native scores of part names against records that have a wrong name and an alias, with the bonus for the name's own domain."""
    p = read(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    left = p.select(F.col("id").alias("l_id"), "p_name", F.concat(F.lit("https://"), F.replace("p_name", F.lit(" "), F.lit("")), F.lit(".example/")).alias("url"))
    left = matching.prepared(left, "p_name", records.LEGAL, records.GENERIC, "l_").drop("p_name")
    right = matching.variants(p.select(F.col("id").alias("r_id"), F.concat(F.lit("Zz"), _s("id")).alias("r_name"), F.array(F.concat(F.col("p_name"), F.lit(" Inc")), F.lit(" ")).alias("aliases")), "r_id", "r_name", "aliases")
    right = matching.prepared(right, "r_name", records.LEGAL, records.GENERIC, "r_")
    pairs = matching.candidates(left, right, "l_id", "variant").join(left, "l_id").join(right, "variant").withColumns(matching.token_scores())
    scored = pairs.withColumn("score", F.greatest("set_score", "key_score"))
    best = matching.best_of_variants(scored, "l_id", "r_id", matching.domain_bonus(F.col("l_key"), F.col("url")) / 2)
    return best.select("l_id", "r_id", F.round("score", 4).alias("score"))


def sample_flags(spark, sf):
    k = F.col("o_orderkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    adoption = read(spark, sf, "orders").select("o_orderkey", "o_custkey", pick("direct_public", "subsidiary_of_public", "private").alias("listing_status"), pick("merchant_level", "parent_level").alias("level"), pick("exclude_false_public_match", None, "confirmed_or_manually_mapped_public", "auto_public_match_needs_light_review", "x").alias("audit"), pick("NYSE", "OTC Markets", "LSE", None).alias("exchange"))
    public = read(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("clean_key"), "c_mktsegment")
    x = panel.joined_sample(adoption, public, "o_custkey", "clean_key", ["c_mktsegment"])
    return x.withColumns(panel.sample_flags(*map(F.col, ("listing_status", "level", "audit", "exchange")))).drop("level", "listing_status", "exchange")


def core_sample(spark, sf):
    return panel.core(sample_flags(spark, sf), "audit").select("o_orderkey", "audit", "sample_main")


def fetch_audit(spark, sf):
    k = F.col("s_suppkey")
    sample = read(spark, sf, "supplier").select(k.alias("entity"), F.concat(F.lit("t"), (k % 60).cast("string")).alias("ticker"))
    fetched = read(spark, sf, "supplier").filter("s_suppkey % 3 <> 0").select(k.alias("cik"), (k % 5 != 0).alias("ok"))
    found = read(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(k.alias("entity"), F.lit("revenue; assets").alias("metrics_found"))
    return facts.audit(sample, _tickers(spark, sf), fetched, found)


def metric_counts(spark, sf):
    return facts.counted_metrics(panel_queries.metric_pivot(spark, sf), ["revenue", "assets"])


def row_range(spark, sf):
    return resume.rows_from(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 500)


def cached_results(spark, sf):
    results = read(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("result"))
    return resume.write_back(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), results, "o_custkey")


def manual_overrides(spark, sf):
    c = read(spark, sf, "customer")
    k = F.col("c_custkey")
    rows = c.select(k.alias("ordinal"), F.concat(F.lit(" Name "), (k % 50).cast("string"), F.lit(" Inc")).alias("merchant_name"), F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("s"), k.cast("string"))).alias("listing_status"))
    return labels.overrides(rows, "ordinal", records.LEGAL).select("merchant_key", "ordinal", "listing_status")


def search_fallback(spark, sf):
    p = read(spark, sf, "pages")
    first = p.filter("page_id % 3 = 0").select((F.col("page_id") % 40).alias("query"), "page_id", F.lit("a").alias("source"))
    return evidence.with_fallback(first, p.filter("page_id % 2 = 0").select((F.col("page_id") % 40).alias("query"), "page_id", F.lit("b").alias("source")), "query")


def readable_pages(spark, sf):
    k = F.col("page_id")
    p = read(spark, sf, "pages").withColumns({"status": F.when(k % 5 == 0, 404).when(k % 5 == 1, 200), "content_type": F.when(k % 2 == 0, "Text/HTML; charset=utf-8").otherwise("application/pdf"), "html": F.when(k % 3 == 0, F.lit("%PDF")).otherwise(F.col("html"))})
    return evidence.readable(p).select("page_id")


_NAMES = ["Ththre", "The Example", "Ththth & Co", "M"]


def official_sites(spark, sf):
    k = F.col("page_id")
    key = k % 16
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (key % 4 + 1).cast("int"))
    said = F.when(k % 5 == 0, "Official Shop").when(k % 5 == 1, "a STORE").otherwise("")
    r = read(spark, sf, "pages").select(key.alias("key"), name.alias("name"), k.alias("rank"), said.alias("title"), F.lit(None).cast("string").alias("body"), F.col("url").alias("href"))
    return evidence.official_site(r, "key", ["m."], ["example.org"], ["official", "store", "shop"], ["inc", "co"])


def search_bundle(spark, sf):
    k = F.col("page_id")
    name = F.concat(F.lit("Name"), (k % 10).cast("string"))
    asked = read(spark, sf, "pages").select(name.alias("name")).distinct().select("name", evidence.search_queries(F.col("name"), X.friendly_name(F.col("name")), F.lit("United Kingdom"), {"name3": ["own query"]}).alias("queries"))
    query = F.when(k % 20 == 3, "own query").when(k % 20 < 10, F.concat(F.lit('"'), name, F.lit('" products'))).otherwise(F.concat(F.lit('"Name '), (k % 10).cast("string"), F.lit('" official website store UK')))
    results = read(spark, sf, "pages").select(query.alias("query"), (F.floor(k / 20) + 1).alias("rank"), F.concat(F.lit("T "), k.cast("string")).alias("title"), F.lit(None).cast("string").alias("body"), F.when(k % 7 != 0, F.col("url")).alias("href"))
    return evidence.evidence_bundle(asked, results, "name", ["example.net"])


def extra_pages(spark, sf):
    """Two links of each page to read further, and what the landed pages there say."""
    p = read(spark, sf, "pages").select("page_id", "url", evidence.title(F.col("html")).alias("title"))
    blank = {c: F.lit("") for c in ("description", "schema_text", "nav", "headings", "body")}
    links = F.array(F.lit("https://x/help/1"), F.col("url"), F.lit("https://x/Login"), F.lit("https://x/gone"), F.lit("https://x/b"))
    page = lambda *more: F.struct(F.col("title").alias("title"), *[v.alias(k) for k, v in blank.items()], *more)
    return evidence.extra_evidence(p.select("page_id", page(links.alias("internal_links")).alias("evidence")), p.dropDuplicates(["url"]).select("url", page().alias("evidence")), "page_id", 2)


def provider_listings(spark, sf):
    k = F.col("p_partkey")
    text = F.when(k % 7 == 0, "Help").when(k % 7 == 1, "12345").when(k % 7 == 2, F.upper("p_name")).when(k % 7 == 3, "x").when(k % 7 == 4, "me@x").when(k % 7 == 5, F.concat("p_name", F.lit("\nSports\nKlarna at checkout"))).otherwise(F.col("p_name"))
    n = (F.floor(k / 35) % 5).cast("string")
    to = F.element_at(F.array(*map(F.lit, ["https://www.klarna.com/us/store/", "https://www.afterpay.com/en-us/stores/", "https://www.clearpay.co.uk/en-GB/stores/", "https://zip.co/us/store/", "https://zip.co/us/store/directory/"])), (k % 5 + 1).cast("int"))
    anchors = read(spark, sf, "part").select("p_partkey", text.alias("text"), F.concat(to, n, F.lit("?a=1")).alias("href"))
    out = None
    for provider, rules in zip("ABCDE", providers.RULES.values(), strict=True):
        part = evidence.first_seen(evidence.listings(anchors, rules), "p_partkey", rules["seen"]).select(F.lit(provider).alias("provider"), "p_partkey", "name")
        out = part if out is None else out.unionByName(part)
    return out


_TICKERS = "tickers AS (SELECT 'T' || (s_suppkey % 40) AS ticker, min(s_suppkey) AS cik, arg_min(s_name, s_suppkey) AS title FROM supplier GROUP BY 1)"
_ENTITIES = """e AS (
  SELECT s_suppkey AS k, 'Q' || s_suppkey AS qid, s_name AS label, CASE WHEN s_suppkey % 3 = 0 THEN 'X' || s_suppkey END AS ticker, (s_suppkey * 7) % 100 AS p, (s_suppkey * 3) % 100 AS o, 's' || s_suppkey || '.example' AS site FROM supplier
)"""
_ADOPTION = """a AS (
  SELECT o_orderkey, o_custkey, o_orderkey % 3 AS l, o_orderkey % 2 AS v, (['exclude_false_public_match', NULL, 'confirmed_or_manually_mapped_public', 'auto_public_match_needs_light_review', 'x'])[o_orderkey % 5 + 1] AS audit, o_orderkey % 5 <> 0 AS sound, o_orderkey % 4 IN (0, 1) AS reports FROM orders
)"""
QUERIES = {
    "exchange_records": (exchange_records, "SELECT s_suppkey, s_name || ' - Class A' AS name, 'T' || s_suppkey AS ticker, 'NYSE' AS exchange, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, s_name AS alias FROM supplier WHERE s_suppkey % 5 <> 0"),
    "ticker_map": (_tickers, "WITH " + _TICKERS + " SELECT * FROM tickers"),
    "quote_records": (quote_records, """WITH q AS (
  SELECT s_nationkey, s_suppkey AS o, 0 AS p, 'S' || (s_suppkey % 30) AS ticker, CASE WHEN s_suppkey % 4 <> 0 THEN s_name || ' Inc' ELSE 'Short' END AS name, 'NYSE' AS exchange, CASE WHEN s_suppkey % 4 <> 0 THEN 'Short|' || s_name || ' Inc' ELSE 'Short' END AS aliases FROM supplier WHERE s_suppkey % 3 <> 0
  UNION ALL SELECT s_nationkey, s_suppkey, 1, 'W', 'Oak Inc', '', s_suppkey || '|Oak Inc' FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 2 = 1
) SELECT s_nationkey, ticker, name, exchange, aliases FROM q QUALIFY row_number() OVER (PARTITION BY s_nationkey, ticker, name ORDER BY o DESC, p DESC) = 1"""),
    "entity_claims": (entity_claims, "WITH " + _ENTITIES + " SELECT qid, label, 'e|m' AS aliases, coalesce(ticker, '') AS ticker, 'Q' || p || '|Q' || p AS parents, 'Q' || o AS owners FROM e"),
    "entity_matches": (entity_matches, "WITH " + _ENTITIES + """, h AS (
  SELECT c_custkey, e.*, least(100.0, 45 + (c_custkey * 37) % 60 + CASE WHEN c_custkey % 2 = 0 THEN 10 ELSE 0 END)::DOUBLE AS score FROM customer JOIN e ON e.k = c_custkey % 120
), u AS (SELECT DISTINCT c_custkey, score, unnest([p, o]) AS up FROM h WHERE score >= 70)
SELECT c_custkey, qid AS id, score, 'wikidata_direct_ticker' AS method, ticker, label AS name FROM h WHERE ticker IS NOT NULL AND score >= 75
UNION ALL SELECT c_custkey, e.qid, u.score, 'wikidata_public_parent', e.ticker, e.label FROM u JOIN e ON e.k = u.up WHERE e.ticker IS NOT NULL"""),
    "entity_candidates": (entity_candidates, "WITH RECURSIVE " + _ENTITIES + """, h AS (
  SELECT DISTINCT c_custkey, unnest([c_custkey % 100 + 1, (c_custkey * 7) % 110 + 1]) AS k FROM customer
), p AS (
  SELECT c_custkey, e.*, CASE WHEN c_custkey % 3 = 2 THEN 'suplier ' ELSE 'supplier ' END || lpad(CAST(CASE WHEN c_custkey % 3 = 1 THEN (c_custkey * 7) % 100 + 1 ELSE c_custkey % 100 + 1 END AS VARCHAR), 9, '0') AS a, replace(lower(trim(label)), '#', ' ') AS b,
         CASE WHEN c_custkey % 2 = 0 AND c_custkey % 100 + 1 = e.k THEN 10 ELSE 0 END AS more FROM h JOIN customer USING (c_custkey) JOIN e USING (k)
), ab AS (
  SELECT DISTINCT a, b FROM p UNION SELECT DISTINCT array_to_string(list_sort(string_split(a, ' ')), ' '), array_to_string(list_sort(string_split(b, ' ')), ' ') FROM p
), """ + RATIO_SQL + """, s AS (
  SELECT p.*, least(100, more + greatest(x.ratio, y.ratio, CASE WHEN a = b THEN 100 WHEN left(a, 8) = left(b, 8) OR right(a, 9) = right(b, 9) THEN 50 ELSE 0 END)) AS score
  FROM p JOIN ratio x USING (a, b) JOIN ratio y ON y.a = array_to_string(list_sort(string_split(p.a, ' ')), ' ') AND y.b = array_to_string(list_sort(string_split(p.b, ' ')), ' ')
), u AS (SELECT DISTINCT c_custkey, qid AS via, score, unnest([p, o]) AS up FROM s WHERE score >= 70)
SELECT c_custkey, qid AS id, qid AS via, round(score, 4) AS score, 'wikidata_direct_ticker' AS method, 'wikidata_entity' AS entity_type, label AS name, ticker, '' AS exchange FROM s WHERE ticker IS NOT NULL AND score >= 75
UNION ALL SELECT c_custkey, e.qid, via, round(score, 4), 'wikidata_public_parent', 'public_parent', e.label, e.ticker, '' FROM u JOIN e ON e.k = u.up WHERE e.ticker IS NOT NULL"""),
    "market_ranks": (market_ranks, """WITH m AS (
  SELECT s_nationkey, s_suppkey, 70 + s_suppkey % 3 AS score, CASE s_suppkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE CASE WHEN s_suppkey % 2 = 0 THEN 5 ELSE 2 END END AS market, CASE WHEN s_suppkey % 2 = 0 THEN 'A.' || s_suppkey ELSE 'AB' END AS ticker, s_name FROM supplier
), r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY score DESC, market, length(ticker), length(s_name), ticker, s_suppkey) AS place FROM m)
SELECT s_nationkey, s_suppkey, CAST(place AS INTEGER) AS place, CAST(market AS BIGINT) AS market FROM r WHERE place <= 6"""),
    "alias_scores": (alias_scores, """WITH n AS (SELECT p_name, min(p_partkey) AS id, list_distinct(string_split(p_name, ' ')) AS t FROM part GROUP BY p_name
), p AS (
  SELECT a.id AS l_id, b.id AS r_id, a.p_name AS x, b.p_name AS y, len(list_intersect(a.t, b.t)) AS shared, greatest(len(a.t), len(b.t)) AS most, least(len(a.t), len(b.t)) AS fewest FROM n a, n b
), s AS (
  SELECT *, CASE WHEN shared < fewest THEN 100.0 * shared / most WHEN shared = most THEN 100 ELSE 75 + 20.0 * shared / most END AS set_score, replace(x, ' ', '') AS lk, replace(y, ' ', '') AS rk FROM p WHERE shared > 0
) SELECT l_id, r_id, round(least(100, 4 + greatest(set_score, CASE WHEN lk = rk THEN 100 WHEN length(lk) >= 5 AND contains(rk, lk) THEN 94 WHEN length(rk) >= 5 AND contains(lk, rk) THEN 92 ELSE 0 END)), 4) AS score FROM s"""),
    "sample_flags": (sample_flags, "WITH " + _ADOPTION + " SELECT o_orderkey, o_custkey, audit, c_mktsegment, l = 0 AND v = 0 AND sound AS sample_main, l = 1 AND v = 1 AND sound AS sample_parent, reports FROM a LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey"),
    "core_sample": (core_sample, "WITH " + _ADOPTION + " SELECT o_orderkey, audit, l = 0 AND v = 0 AND sound AS sample_main FROM a WHERE o_orderkey % 5 IN (2, 3)"),
    "fetch_audit": (fetch_audit, "WITH " + _TICKERS + """, s AS (
  SELECT s_suppkey AS entity, 't' || (s_suppkey % 60) AS ticker, t.cik, coalesce(t.title, '') AS title, CASE WHEN t.cik IS NULL THEN 'no_sec_ticker_match' WHEN t.cik % 3 <> 0 AND t.cik % 5 <> 0 THEN 'ok' ELSE 'fetch_error' END AS fetch_status FROM supplier LEFT JOIN tickers t ON t.ticker = 'T' || (s_suppkey % 60)
) SELECT *, CASE WHEN fetch_status = 'ok' AND entity % 2 = 0 THEN 'revenue; assets' ELSE '' END AS metrics_found FROM s"""),
    "metric_counts": (metric_counts, f"WITH p AS ({panel_queries.QUERIES['metric_pivot'][1]}) SELECT 'revenue' AS metric, count(revenue) AS n FROM p UNION ALL SELECT 'assets', count(assets) FROM p"),
    "row_range": (row_range, "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 100"),
    "cached_results": (cached_results, "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 3 = 0 THEN c_mktsegment ELSE '' END AS result FROM orders JOIN customer ON c_custkey = o_custkey"),
    "manual_overrides": (manual_overrides, "SELECT 'name' || (c_custkey % 50) AS merchant_key, max(c_custkey) AS ordinal, 's' || max(c_custkey) AS listing_status FROM customer WHERE c_custkey % 4 <> 0 GROUP BY c_custkey % 50"),
    "search_fallback": (search_fallback, """WITH a AS (SELECT page_id % 40 AS query, page_id, 'a' AS source FROM pages WHERE page_id % 3 = 0)
SELECT * FROM a UNION ALL SELECT page_id % 40, page_id, 'b' FROM pages WHERE page_id % 2 = 0 AND page_id % 40 NOT IN (SELECT query FROM a)"""),
    "readable_pages": (readable_pages, "SELECT page_id FROM pages WHERE page_id % 5 <> 0 AND (page_id % 2 = 0 OR page_id % 3 <> 0)"),
    "official_sites": (official_sites, """WITH r AS (
  SELECT page_id % 16 AS key, page_id, url, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\\.', '') AS d, (['ththre', 'theexample', 'thththand', 'm'])[page_id % 4 + 1] AS own, page_id % 4 AS n FROM pages
), c AS (
  SELECT *, replace(replace(replace(regexp_replace(d, '[^a-z0-9]+', '', 'g'), 'com', ''), 'co', ''), 'net', '') AS core FROM r WHERE NOT contains(d, 'm.') AND NOT regexp_matches(d, '(^|\\.)example\\.org$')
), s AS (
  SELECT *, CASE WHEN own = core THEN 5 WHEN contains(core, own) THEN 4 WHEN contains(own, core) AND length(core) >= 4 THEN 3
    ELSE CASE n WHEN 1 THEN CAST(contains(core, 'the') AS INTEGER) + CAST(contains(core, 'example') AS INTEGER) WHEN 2 THEN CAST(contains(core, 'ththth') AS INTEGER) ELSE 0 END END + CASE page_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS points FROM c
) SELECT key, url AS href, points FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY points DESC, page_id) = 1"""),
    "search_bundle": (search_bundle, """WITH r AS (
  SELECT page_id, 'Name' || (page_id % 10) AS name, CASE WHEN page_id % 20 = 3 THEN 10 WHEN page_id % 20 < 10 THEN 1 ELSE 5 END AS nth, page_id // 20 + 1 AS rank, CASE WHEN page_id % 7 <> 0 THEN url ELSE '' END AS href FROM pages
), n AS (SELECT DISTINCT name FROM r)
SELECT n.name, left(coalesce(t, ''), 10000) AS evidence FROM n LEFT JOIN (
  SELECT name, string_agg('TITLE: T ' || page_id || ' | SNIPPET: | URL:' || CASE WHEN href = '' THEN '' ELSE ' ' || href END, ' ' ORDER BY nth, rank) AS t FROM r WHERE rank <= 5 AND NOT contains(lower(regexp_extract(href, '^https?://([^/?#]*)', 1)), 'example.net') GROUP BY name) x ON x.name = n.name"""),
    "extra_pages": (extra_pages, "SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[\\s\\x{00A0}]+', ' ', 'g')) AS extra FROM pages"),
    "provider_listings": (provider_listings, """WITH a AS (
  SELECT p_partkey, p_partkey % 7 AS t, p_partkey % 5 AS h, CAST((p_partkey // 35) % 5 AS VARCHAR) AS n, CASE p_partkey % 7 WHEN 0 THEN 'Help' WHEN 1 THEN '12345' WHEN 2 THEN upper(p_name) WHEN 3 THEN 'x' WHEN 4 THEN 'me@x' ELSE p_name END AS name FROM part
), f AS (
  SELECT 'A' AS provider, p_partkey, CASE WHEN t = 5 THEN name || ' Sports Klarna at checkout' ELSE name END AS name, lower(CASE WHEN t = 5 THEN name || ' Sports Klarna at checkout' ELSE name END) AS k, '' AS l FROM a WHERE t NOT IN (0, 1)
  UNION ALL SELECT 'B', p_partkey, name, lower(name), h || n FROM a WHERE t NOT IN (0, 1) AND (t = 5 OR h IN (0, 3, 4) AND (h <> 4 OR true))
  UNION ALL SELECT 'C', p_partkey, CASE WHEN t = 5 THEN name || ' Sports Klarna at checkout' ELSE name END, lower(CASE WHEN t = 5 THEN name || ' Sports Klarna at checkout' ELSE name END), n FROM a WHERE t NOT IN (0, 1) AND h = 1
  UNION ALL SELECT 'D', p_partkey, CASE WHEN t = 5 THEN name || ' Sports Klarna at checkout' ELSE name END, regexp_replace(lower(CASE WHEN t = 5 THEN name || ' Sports Klarna at checkout' ELSE name END), '[^a-z0-9]+', '', 'g'), '' FROM a WHERE t NOT IN (0, 1, 4) AND h = 2
  UNION ALL SELECT 'E', p_partkey, CASE WHEN t = 5 THEN name || ' Sports Klarna at checkout' ELSE name END, regexp_replace(lower(CASE WHEN t = 5 THEN name || ' Sports Klarna at checkout' ELSE name END), '[^a-z0-9]+', '', 'g'), n FROM a WHERE t NOT IN (0, 1, 3) AND h = 3
) SELECT provider, p_partkey, name FROM f QUALIFY row_number() OVER (PARTITION BY provider, k, l ORDER BY p_partkey) = 1"""),
}
