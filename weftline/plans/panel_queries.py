"""Queries over facts, evidence, panels and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import facts, panel, regress
from ..streaming import resume
from .tables import read

METRICS = ["revenue", "gross_profit", "operating_income", "net_income", "assets"]


def _money(c):
    return F.sum(c.cast("decimal(38,6)")).cast("double")


def _panel(spark, sf, annual=False):
    """A panel by supplier and ship quarter (or year): sums of line items in the roles of reported metrics."""
    l = read(spark, sf, "lineitem")
    y, q = F.year("l_shipdate"), F.quarter("l_shipdate")
    period = (y if annual else y * 4 + q).cast("long").alias("period")
    price, off, tax = (F.col(c).cast("decimal(12,4)") for c in ("l_extendedprice", "l_discount", "l_tax"))
    return l.groupBy(F.col("l_suppkey").alias("entity"), period).agg(
        _money(price).alias("revenue"), _money(price * (1 - off)).alias("gross_profit"), _money(price * (F.lit(0.05).cast("decimal(12,4)") - off)).alias("operating_income"),
        _money(price * (F.lit(0.04).cast("decimal(12,4)") - off - tax * F.lit(0).cast("decimal(12,4)"))).alias("net_income"), _money(F.col("l_quantity").cast("decimal(12,4)")).alias("assets"))


def _panel_sql(period: str) -> str:
    return f"""panel AS (
  SELECT l_suppkey AS entity, CAST({period} AS BIGINT) AS period, CAST(sum(e) AS DOUBLE) AS revenue, CAST(sum(e * (1 - d)) AS DOUBLE) AS gross_profit, CAST(sum(e * (0.05 - d)) AS DOUBLE) AS operating_income,
         CAST(sum(e * (0.04 - d)) AS DOUBLE) AS net_income, CAST(sum(CAST(l_quantity AS DECIMAL(12, 4))) AS DOUBLE) AS assets
  FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(12, 4)) AS e, CAST(l_discount AS DECIMAL(12, 4)) AS d FROM lineitem) GROUP BY 1, 2
)"""


_QUARTER = "year(l_shipdate) * 4 + quarter(l_shipdate)"
_OUT = ["gross_margin", "operating_margin", "net_margin", "log_revenue", "roa", "revenue_growth", "operating_income_growth"]


def _outcome_sql(period: str, lag: int, calendar: bool = False) -> str:
    past = f"LEFT JOIN (SELECT entity AS pe, period + {lag} AS pp, revenue AS r0, operating_income AS o0 FROM panel) ON pe = entity AND pp = period" if calendar else ""
    r0, o0 = ("r0", "o0") if calendar else (f"lag(revenue, {lag}) OVER (PARTITION BY entity ORDER BY period)", f"lag(operating_income, {lag}) OVER (PARTITION BY entity ORDER BY period)")
    return f"""{_panel_sql(period)}, outcomes AS (
  SELECT entity, period, revenue, gross_profit / nullif(revenue, 0) AS gross_margin, operating_income / nullif(revenue, 0) AS operating_margin, net_income / nullif(revenue, 0) AS net_margin,
         CASE WHEN revenue > 0 THEN ln(revenue) END AS log_revenue, net_income / nullif(assets, 0) AS roa, revenue / nullif({r0}, 0) - 1 AS revenue_growth, operating_income / nullif(abs({o0}), 0) - 1 AS operating_income_growth
  FROM panel {past}
)"""


_ROUNDED = "SELECT entity, period, " + ", ".join(f"round({c}, 6) AS {c}" for c in _OUT) + " FROM outcomes"


def _outcomes(spark, sf, annual=False, calendar=False):
    out = panel.outcomes(_panel(spark, sf, annual), "entity", "period", 1 if annual else 4, calendar)
    return out.select("entity", "period", *[F.round(c, 6).alias(c) for c in _OUT])


def _events(spark, sf):
    """The first quarter in which a supplier ships a line of over 45 pieces at no discount."""
    l = read(spark, sf, "lineitem").filter("l_quantity >= 45 and l_discount = 0.0")
    return l.groupBy(F.col("l_suppkey").alias("entity")).agg(X.quarter_index(F.min("l_shipdate")).alias("event_index"))


_EVENTS = "events_ AS (SELECT l_suppkey AS entity, CAST(year(min(l_shipdate)) * 4 + quarter(min(l_shipdate)) AS BIGINT) AS event_index FROM lineitem WHERE l_quantity >= 45 AND l_discount = 0.0 GROUP BY 1)"


def event_panel(spark, sf):
    p = panel.align(_panel(spark, sf).select("entity", "period", "revenue"), _events(spark, sf), "entity", "period", 40)
    return p.withColumn("revenue", F.round("revenue", 4))


def _regression(spark, sf):
    p = panel.align(_panel(spark, sf), _events(spark, sf), "entity", "period", 40)
    return panel.outcomes(p, "entity", "period", 4)


def twfe_regression(spark, sf):
    return regress.twfe(_regression(spark, sf), ["revenue_growth", "gross_margin", "operating_margin", "net_margin", "roa", "operating_income_growth"], "entity", "period", "post")


def twfe_balanced(spark, sf):
    """Mean order price by region and year, where each region has every year; post begins in another year in each region."""
    o, c, n = read(spark, sf, "orders"), read(spark, sf, "customer"), read(spark, sf, "nation")
    k = F.col("n_regionkey")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(k.alias("entity"), F.year("o_orderdate").alias("period")).agg(F.avg("o_totalprice").alias("price"))
    rows = rows.withColumn("post", (F.col("period") >= 1994 + F.col("entity") % 4).cast("int"))
    r = regress.twfe(rows, ["price"], "entity", "period", "post")
    return r.select("outcome", "nobs", "n_firms", *[F.round(x, 4).alias(x) for x in ("coef_post", "se_cluster", "t_stat", "p_value")], "status")


def twfe_counts(spark, sf):
    c = regress.cells(_regression(spark, sf), ["revenue_growth", "gross_margin"], "entity", "period", "post")
    return c.groupBy("outcome").agg(F.sum("n").alias("nobs"), F.count_distinct("entity").alias("n_firms"), F.count_distinct("period").alias("n_periods"))


def json_fields(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.concat(F.lit('{"fields": ["id", "k"], "data": [["'), F.col("event_id").cast("string"), F.lit('", "'), F.get_json_object("props", "$.k"), F.lit('"], ["x", null]]}')).alias("doc"))
    m = F.col("record")
    return facts.columnar_records(e, "doc", ["event_id"]).select("event_id", F.col("ordinal"), F.lpad(m["id"], 10, "0").alias("id"), m["k"].try_cast("long").alias("k"))


def _facts(spark, sf):
    l = read(spark, sf, "lineitem")
    y, q = F.year("l_shipdate"), F.quarter("l_shipdate")
    k = F.col("l_orderkey") % 4
    return l.select(
        F.col("l_suppkey").alias("entity"), F.when(F.col("l_linenumber") % 2 == 0, "assets").otherwise("revenue").alias("metric"),
        F.concat(F.lit("CY"), y.cast("string"), F.when(k == 3, F.lit("")).otherwise(F.concat(F.lit("Q"), q.cast("string"), F.when(k == 2, "I").otherwise("")))).alias("frame"),
        F.when(F.col("l_returnflag") == "R", "10-K/A").when(F.col("l_returnflag") == "A", "8-K").otherwise("10-K").alias("form"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("filed"),
        F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("accn"), F.concat(F.lit("tag"), F.col("l_linenumber").cast("string")).alias("tag"), F.col("l_linenumber").alias("tag_ordinal"), F.col("l_extendedprice").alias("val"))


_FACTS = """facts AS (
  SELECT l_suppkey AS entity, CASE WHEN l_linenumber % 2 = 0 THEN 'assets' ELSE 'revenue' END AS metric, l_orderkey % 4 AS k, year(l_shipdate) AS year, quarter(l_shipdate) AS quarter,
         CASE WHEN l_returnflag = 'R' THEN '10-K/A' ELSE '10-K' END AS form, strftime(l_shipdate, '%Y-%m-%d') AS filed, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS accn, 'tag' || l_linenumber AS tag, l_linenumber AS tag_ordinal, l_extendedprice AS val
  FROM lineitem WHERE l_returnflag <> 'A'
), quarterly AS (SELECT * FROM facts WHERE k <> 3), annual AS (SELECT * FROM facts WHERE k = 3 OR (k <> 3 AND metric = 'assets' AND quarter = 4))"""
_CHOSEN = "ORDER BY form LIKE '%/A', filed DESC, accn DESC, tag_ordinal"


def fact_choice(spark, sf):
    quarterly, _ = facts.by_period(facts.usable(_facts(spark, sf)), ["assets"])
    return facts.choose(quarterly, ["entity", "metric", "year", "quarter"]).select("entity", "metric", F.col("year").cast("long").alias("year"), F.col("quarter").cast("long").alias("quarter"), "form", "filed", "accn", "tag", "val")


def metric_pivot(spark, sf):
    _, annual = facts.by_period(facts.usable(_facts(spark, sf)), ["assets"])
    one = facts.choose(annual, ["entity", "metric", "year"])
    return facts.wide(one.withColumn("year", F.col("year").cast("long")), ["entity", "year"], ["revenue", "assets"])


def metrics_found(spark, sf):
    return facts.found_metrics(metric_pivot(spark, sf), "entity", ["revenue", "assets"])


def _evidence(spark, sf):
    e = read(spark, sf, "events")
    strength = F.when(F.col("event_type") == "error", "planned_not_final_adoption").when(F.col("event_type") != "view", F.col("event_type"))
    day = F.col("ts").cast("date")
    text = F.when(F.col("event_id") % 2 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(X.display_date(day))
    return e.select(F.col("user_id").alias("entity"), F.col("event_id").alias("ordinal"), X.parse_date(text).alias("date"), strength.alias("strength"), F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("provider"))


_EVIDENCE = "ev AS (SELECT user_id AS entity, event_id AS ordinal, CAST(ts AS DATE) AS date, CASE event_type WHEN 'error' THEN 'planned_not_final_adoption' WHEN 'view' THEN NULL ELSE event_type END AS strength, 'p' || (event_id % 3) AS provider FROM events)"


def earliest_evidence(spark, sf):
    x = panel.earliest(_evidence(spark, sf), "entity")
    return x.select("entity", "ordinal", X.display_date(F.col("date")).alias("shown"), F.coalesce("strength", F.lit("")).alias("strength"), "provider")


def evidence_note(spark, sf):
    line = F.concat_ws(" ", X.display_date(F.col("date")), "provider", F.coalesce("strength", F.lit("-")))
    return panel.notes(_evidence(spark, sf), "entity", line)


def adoption_sample(spark, sf):
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy/M/d")).otherwise("unknown")
    x = panel.sample(o.select("o_orderkey", text.alias("t")), X.parse_date(F.col("t")))
    return x.withColumn("adoption_date", F.date_format("adoption_date", "yyyy-MM-dd")).drop("t")


def windowed_events(spark, sf):
    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    x = resume.windowed_counts(e, "ts", "event_type", "1 day")
    return x.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {
    "panel_outcomes_quarterly": (_outcomes, "WITH " + _outcome_sql(_QUARTER, 4) + " " + _ROUNDED),
    "panel_outcomes_annual": (lambda s, d: _outcomes(s, d, True), "WITH " + _outcome_sql("year(l_shipdate)", 1) + " " + _ROUNDED),
    "panel_outcomes_calendar": (lambda s, d: _outcomes(s, d, False, True), "WITH " + _outcome_sql(_QUARTER, 4, True) + " " + _ROUNDED),
    "event_panel": (event_panel, "WITH " + _panel_sql(_QUARTER) + ", " + _EVENTS + " SELECT entity, period, round(revenue, 4) AS revenue, event_index, period - event_index AS event_time, CAST(period >= event_index AS INTEGER) AS post FROM panel JOIN events_ USING (entity) WHERE period - event_index BETWEEN -40 AND 40"),
    "twfe_regression": (twfe_regression, None),
    "twfe_balanced": (twfe_balanced, """WITH r AS (
  SELECT n_regionkey AS e, year(o_orderdate) AS t, avg(o_totalprice) AS y, CASE WHEN year(o_orderdate) >= 1994 + n_regionkey % 4 THEN 1.0 ELSE 0.0 END AS p
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 4
), d AS (
  SELECT e, t, p - avg(p) OVER (PARTITION BY e) - avg(p) OVER (PARTITION BY t) + avg(p) OVER () AS p, y - avg(y) OVER (PARTITION BY e) - avg(y) OVER (PARTITION BY t) + avg(y) OVER () AS y FROM r
), b AS (
  SELECT sum(p * y) / sum(p * p) AS b, sum(p * p) AS pp, count(*) AS n, count(DISTINCT e) AS g, count(DISTINCT t) AS s FROM d
), m AS (
  SELECT sum(x * x) AS meat FROM (SELECT e, sum(p * (y - b * p)) AS x FROM d, b GROUP BY e)
), v AS (
  SELECT *, sqrt(meat / (pp * pp) * g / (g - 1) * (n - 1) / (n - (g + s))) AS se FROM b, m
), z AS (
  SELECT *, b / se AS t, b * b / (2 * se * se) AS z2 FROM v
) SELECT 'price' AS outcome, n AS nobs, g AS n_firms, round(b, 4) AS coef_post, round(se, 4) AS se_cluster, round(t, 4) AS t_stat,
  round(1 - 2 * sqrt(z2 / pi()) * list_sum([CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * exp(k * ln(z2) - lgamma(k + 1)) / (2 * k + 1) FOR k IN range(0, 90)]), 4) AS p_value, 'ok' AS status FROM z"""),
    "twfe_counts": (twfe_counts, "WITH " + _panel_sql(_QUARTER) + ", " + _EVENTS + """, w AS (
  SELECT p.* FROM panel p JOIN events_ USING (entity) WHERE period - event_index BETWEEN -40 AND 40
), o AS (
  SELECT entity, period, gross_profit / nullif(revenue, 0) AS gross_margin, revenue / nullif(lag(revenue, 4) OVER (PARTITION BY entity ORDER BY period), 0) - 1 AS revenue_growth FROM w
) SELECT 'gross_margin' AS outcome, count(*) AS nobs, count(DISTINCT entity) AS n_firms, count(DISTINCT period) AS n_periods FROM o WHERE gross_margin IS NOT NULL
UNION ALL SELECT 'revenue_growth', count(*), count(DISTINCT entity), count(DISTINCT period) FROM o WHERE revenue_growth IS NOT NULL"""),
    "json_fields": (json_fields, "SELECT event_id, 0 AS ordinal, lpad(CAST(event_id AS VARCHAR), 10, '0') AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events UNION ALL SELECT event_id, 1, '000000000x', NULL FROM events"),
    "fact_choice": (fact_choice, "WITH " + _FACTS + f" SELECT entity, metric, CAST(year AS BIGINT) AS year, CAST(quarter AS BIGINT) AS quarter, form, filed, accn, tag, val FROM (SELECT *, row_number() OVER (PARTITION BY entity, metric, year, quarter {_CHOSEN}) AS rn FROM quarterly) WHERE rn = 1"),
    "metric_pivot": (metric_pivot, "WITH " + _FACTS + f""", c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, metric, year {_CHOSEN}) AS rn FROM annual) WHERE rn = 1)
SELECT entity, CAST(year AS BIGINT) AS year, any_value(val) FILTER (WHERE metric = 'revenue') AS revenue, any_value(tag) FILTER (WHERE metric = 'revenue') AS revenue_source, any_value(val) FILTER (WHERE metric = 'assets') AS assets, any_value(tag) FILTER (WHERE metric = 'assets') AS assets_source FROM c GROUP BY 1, 2"""),
    "metrics_found": (metrics_found, "WITH " + _FACTS + " SELECT entity, concat_ws('; ', CASE WHEN bool_or(metric = 'revenue') THEN 'revenue' END, CASE WHEN bool_or(metric = 'assets') THEN 'assets' END) AS metrics_found FROM annual GROUP BY entity"),
    "earliest_evidence": (earliest_evidence, "WITH " + _EVIDENCE + """ SELECT entity, ordinal, year(date) || '/' || month(date) || '/' || day(date) AS shown, coalesce(strength, '') AS strength, provider FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date, strength NULLS FIRST, provider, ordinal) AS rn FROM ev WHERE coalesce(strength, '') <> 'planned_not_final_adoption') WHERE rn = 1"""),
    "evidence_note": (evidence_note, "WITH " + _EVIDENCE + " SELECT entity, string_agg(year(date) || '/' || month(date) || '/' || day(date) || ' ' || provider || ' ' || coalesce(strength, '-'), ' | ' ORDER BY date, provider, ordinal) AS note FROM ev GROUP BY entity"),
    "adoption_sample": (adoption_sample, """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS adoption_date, year(o_orderdate) AS adoption_year, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS adoption_quarter,
  year(o_orderdate) * 4 + quarter(o_orderdate) AS adoption_index, year(o_orderdate) - 10 AS window_start, year(o_orderdate) + 10 AS window_end FROM orders WHERE o_orderkey % 3 <> 2"""),
    "windowed_events": (windowed_events, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
}
