"""Queries over entities: keys, overlaps, pivots, shares, labels, flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import brands, dedupe, labels, overlap
from . import tables
from .tables import LISTING, MASTER, PROVIDERS, mode_sql, read

RETAIL, LEGAL, GENERIC = ["official store", "official", "store", "shop"], ["inc", "llc", "ltd", "co", "corp"], ["the", "group", "small"]


def _master(spark, sf):
    return overlap.master(tables.listings(spark, sf))


def _summary(spark, sf):
    return overlap.summary(_master(spark, sf), PROVIDERS)


_FLAGS = ", ".join(f"CAST(max(CASE WHEN provider = '{p}' THEN 1 ELSE 0 END) AS INTEGER) AS has_{overlap.column_name(p)}" for p in PROVIDERS)
SUMMARY = MASTER + f""", summary AS (
  SELECT a.*, b.m AS broad_industry, s.m AS sub_industry FROM (
    SELECT entity_key, arg_min(name, (length(name), lower(name), name)) AS canonical_name, array_to_string(list_sort(list_distinct(list(name))), ' | ') AS name_variants,
           array_to_string(list_sort(list_distinct(list(provider))), '; ') AS provider_set, count(DISTINCT provider) AS provider_count,
           array_to_string(list_sort(list_distinct(list(country))), '; ') AS country_set,
           coalesce(array_to_string(list_sort(list_distinct(list(url) FILTER (WHERE url <> ''))), ' | '), '') AS urls, array_to_string(list_sort(list_distinct(list(file))), '; ') AS files, {_FLAGS}
    FROM master GROUP BY entity_key) a
  JOIN {mode_sql('broad')} b USING (entity_key) JOIN {mode_sql('sub')} s USING (entity_key)
)"""


def _alias(spark, sf):
    keys = overlap.keyed(tables.listings(spark, sf)).filter(F.col("entity_key").endswith("0")).select("entity_key").distinct()
    return keys.select(F.col("entity_key").alias("alias_key"), F.concat(F.lit("Group & "), F.substring("entity_key", -2, 1)).alias("canonical"))


_EXCLUDED = {"navigation": ["groupand1", "1996customer000000002"], "provider": ["groupand1", "groupand2"]}


def overlap_alias_merged(spark, sf):
    return overlap.in_order(overlap.aggregate_flags(overlap.merge_aliases(_summary(spark, sf), _alias(spark, sf)), PROVIDERS, _EXCLUDED))


def provider_membership(spark, sf):
    """Flags by column for the first two providers, by the provider set for the others."""
    over = _summary(spark, sf)
    over = over.drop(*[f"has_{overlap.column_name(p)}" for p in PROVIDERS[2:]])
    return over.select("entity_key", *[overlap.has_provider(over, p).alias(f"p{i}") for i, p in enumerate(PROVIDERS)])


def canonical_rows(spark, sf):
    x = tables.listings(spark, sf).withColumn("entity_key", X.key_squashed(F.col("name")))
    x = x.withColumn("name", F.when(F.col("ordinal") % 2 == 0, F.upper("name")).otherwise(F.col("name")))
    return overlap.with_canonical(x).select("ordinal", "entity_key", "name", "canonical_name")


def country_sets(spark, sf):
    c, n = read(spark, sf, "customer"), read(spark, sf, "nation")
    text = F.concat(F.initcap(F.lower("n_name")), F.lit("; UnitedStates|US, "), F.col("n_name"), F.lit(";UK"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", F.array_join(X.country_items(text), "; ").alias("countries"), X.country_hint(F.array_join(X.country_items(text), "; ")).alias("hint"))


def friendly_names(spark, sf):
    squashed = X.squash(F.initcap("p_name"))
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(squashed, F.lit("+Co.com"))).when(F.col("p_partkey") % 3 == 1, F.concat(squashed, F.lit("&Co™"))).otherwise("TheOAK")
    return read(spark, sf, "part").select("p_partkey", X.friendly_name(name, {"TheOAK": "Oak"}).alias("name"))


_HAS = [f"has_{overlap.column_name(p)}" for p in PROVIDERS]

def _united(column: str, name: str, to: str = "item") -> str:
    """A CTE of the items of a delimited column of the aliased summary, each once by lower case in the order of the rows."""
    return f"""{name}_ AS (
  SELECT key, string_agg(item, '; ' ORDER BY at_) AS {name} FROM (
    SELECT key, arg_min({to}, (-provider_count, canonical_name, name_variants, p)) AS item, min((-provider_count, canonical_name, name_variants, p)) AS at_ FROM (
      SELECT *, generate_subscripts(a, 1) AS p, trim(unnest(a)) AS item FROM (SELECT *, regexp_split_to_array({column}, '[;|,]') AS a FROM aliased)) WHERE item <> '' GROUP BY key, lower({to})) GROUP BY key
)"""


_NUMBER = " + ".join(f"CAST({h} AS INTEGER)" for h in _HAS)
_LIST = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {h} THEN '{p}' END" for h, p in zip(_HAS, PROVIDERS, strict=True)) + "], lambda x: x IS NOT NULL), '; ')"
MERGED = SUMMARY + f""", aliased AS (
  SELECT *, CASE WHEN entity_key LIKE '%0' THEN 'groupand' || substr(entity_key, length(entity_key) - 1, 1) ELSE entity_key END AS key FROM summary
), merged AS (
  SELECT key AS entity_key, arg_min(canonical_name, (length(canonical_name), lower(canonical_name), canonical_name)) AS canonical_name, count(*) AS merged_rows, {', '.join(f'bool_or({h} = 1) AS {h}' for h in _HAS)}
  FROM aliased GROUP BY key
), {_united('name_variants', 'name_variants')}, {_united('country_set', 'countries')}, {_united('urls', 'urls')}, {_united('files', 'files')}"""
_MERGED_ROWS = f"""SELECT merged.*, {_LIST} AS providers, CAST({_NUMBER} AS BIGINT) AS provider_count,
  CASE WHEN entity_key IN ('groupand1', '1996customer000000002') THEN 'navigation' WHEN entity_key = 'groupand2' THEN 'provider' ELSE '' END AS exclusion,
  v.name_variants, c.countries, coalesce(u.urls, '') AS urls, f.files
FROM merged JOIN name_variants_ v ON v.key = entity_key JOIN countries_ c ON c.key = entity_key LEFT JOIN urls_ u ON u.key = entity_key JOIN files_ f ON f.key = entity_key"""


def ordered_distinct_union(spark, sf):
    items = X.split_items(F.concat_ws("; ", F.col("provider"), F.lower("provider"), F.concat_ws(",", F.col("sub"), F.col("country"))))
    return dedupe.joined_set(tables.listings(spark, sf), ["name"], items, "ordinal", "items")


def provider_matrix(spark, sf):
    return overlap.matrix(_master(spark, sf), PROVIDERS)


def industry_share_high(spark, sf):
    return overlap.shares(_summary(spark, sf).filter("provider_count >= 3"), "broad_industry")


def _classified(spark, sf):
    o = tables.listings(spark, sf).withColumn("entity_key", X.key_squashed(F.col("name")))
    k = F.col("ordinal") % 11
    return o.select(
        "entity_key", "ordinal", F.when(k == 0, "").when(k == 1, "Exclude - test").when(k == 2, "Other / Unclassified").otherwise(F.col("broad")).alias("broad"),
        F.element_at(F.array(*map(F.lit, ["low", "medium", "high", "manual", ""])), (F.col("ordinal") % 5 + 1).cast("int")).alias("confidence"),
        F.element_at(F.array(*map(F.lit, [*overlap.STATUS_SCORE, "else"])), (F.col("ordinal") % 7 + 1).cast("int")).alias("status"),
        F.when(F.col("ordinal") % 2 == 0, "TRUE").otherwise("FALSE").alias("review"),
    )


CLASSIFIED = """classified AS (
  SELECT entity_key, ordinal, CASE ordinal % 11 WHEN 0 THEN '' WHEN 1 THEN 'Exclude - test' WHEN 2 THEN 'Other / Unclassified' ELSE broad END AS broad,
         (['low', 'medium', 'high', 'manual', ''])[ordinal % 5 + 1] AS confidence, (['official_website_verified', 'official_website_verified_plus_search_fallback', 'search_verified_website_unreachable', 'website_parse_failed_search_fallback', 'search_only_no_official_url', 'needs_manual_review', 'else'])[ordinal % 7 + 1] AS status,
         CASE WHEN ordinal % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS review
  FROM (SELECT *, regexp_replace(replace(lower(regexp_replace(name, '\\s+', '', 'g')), '&', 'and'), '[^a-z0-9]+', '', 'g') AS entity_key FROM listing)
), best AS (
  SELECT * EXCLUDE rn FROM (
    SELECT *, count(*) OVER (PARTITION BY entity_key) AS classified_rows,
           row_number() OVER (PARTITION BY entity_key ORDER BY trim(broad) = '', CASE WHEN trim(broad) = '' THEN 0 ELSE CAST(broad LIKE 'Exclude%' AS INTEGER) END,
             CASE WHEN trim(broad) = '' THEN 0 ELSE CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END END DESC,
             CASE WHEN trim(broad) = '' THEN 0 ELSE CASE status WHEN 'official_website_verified' THEN 4 WHEN 'official_website_verified_plus_search_fallback' THEN 3 WHEN 'search_verified_website_unreachable' THEN 2
               WHEN 'website_parse_failed_search_fallback' THEN 2 WHEN 'search_only_no_official_url' THEN 1 ELSE 0 END END DESC, trim(broad) <> '' AND review = 'TRUE', ordinal) AS rn
    FROM classified) WHERE rn = 1
)"""


def best_record_per_key(spark, sf):
    return overlap.best_classification(_classified(spark, sf))


def final_overlap_flags(spark, sf):
    best = best_record_per_key(spark, sf).filter(~F.col("entity_key").endswith("7"))
    over = _summary(spark, sf).select("entity_key", "provider_count")
    kinds = over.filter(F.col("entity_key").endswith("3")).select("entity_key", F.when(F.substring("entity_key", -2, 1) < "5", "nav").otherwise("internal").alias("kind"))
    out = overlap.final(over, best, kinds)
    return out.select("entity_key", "provider_count", "merge_status", "industry", "is_excluded", "is_active", "is_multi", "is_high", "needs_review")


def key_normalisation(spark, sf):
    """Six keys side by side, of part and customer names dressed up with marks, legal words and odd blanks."""
    p = read(spark, sf, "part").select(F.concat(F.initcap("p_name"), F.lit(" Official Store & Co. "), F.col("p_brand"), F.lit(" Inc")).alias("name"))
    c = read(spark, sf, "customer").select(F.concat(F.col("c_name"), F.lit("™  LLC & Shop")).alias("name"))
    n = F.col("name")
    return p.unionByName(c).distinct().select(
        "name", X.key_squashed(n).alias("key_a"), X.key_trimmed(n, RETAIL, LEGAL).alias("key_b"), X.key_plain(n).alias("key_c"), X.key_lower(n).alias("key_d"),
        X.token_name(n, LEGAL).alias("tokens"), X.key_tokens(n, LEGAL).alias("key_e"), F.array_join(F.array_sort(X.useful_tokens(n, LEGAL, GENERIC)), " ").alias("useful"),
    )


_KEYS = """
WITH n AS (
  SELECT DISTINCT name FROM (
    SELECT array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' Official Store & Co. ' || p_brand || chr(160) || 'Inc' AS name FROM part
    UNION ALL SELECT c_name || '™  LLC & Shop' FROM customer)
), c AS (
  SELECT name, trim(regexp_replace(name, '[\\s\\x{00A0}]+', ' ', 'g')) AS clean, regexp_replace(name, '[\\s\\x{00A0}]+', '', 'g') AS squashed FROM n
), s AS (
  SELECT *, regexp_replace(replace(lower(clean), '&', ' and '), '[™®]', '', 'g') AS spelt,
         list_filter(string_split(regexp_replace(replace(lower(name), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '' AND t NOT IN ('inc', 'llc', 'ltd', 'co', 'corp')) AS tok FROM c
)
SELECT name, regexp_replace(replace(lower(squashed), '&', 'and'), '[^a-z0-9]+', '', 'g') AS key_a,
       regexp_replace(regexp_replace(regexp_replace(spelt, '\\b(official store|official|store|shop)\\b', '', 'g'), '\\b(corp|inc|llc|ltd|co)\\b', '', 'g'), '[^a-z0-9]+', '', 'g') AS key_b,
       regexp_replace(spelt, '[^a-z0-9]+', '', 'g') AS key_c, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS key_d,
       array_to_string(tok, ' ') AS tokens, array_to_string(tok, '') AS key_e,
       array_to_string(list_sort(list_distinct(list_filter(tok, lambda t: length(t) > 1 AND t NOT IN ('the', 'group', 'small')))), ' ') AS useful
FROM s
"""


def cache_key_sha1(spark, sf):
    c, n = read(spark, sf, "customer"), read(spark, sf, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", X.cache_key(X.key_plain(F.col("c_name")), F.col("n_name")).alias("cache_key"))


def modal_value(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_partkey").agg(dedupe.modal(F.col("l_returnflag")).alias("modal_flag"))


def canonical_shortest_name(spark, sf):
    return read(spark, sf, "part").groupBy("p_brand").agg(dedupe.shortest_name("p_name").alias("name"))


def first_and_last(spark, sf):
    """The first and the last order of each customer and priority, by ordinal."""
    o = read(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")
    a = dedupe.keep_first(o, ["o_custkey", "o_orderpriority"], "o_orderkey").withColumn("which", F.lit("first"))
    return a.unionByName(dedupe.keep_last(o, ["o_custkey", "o_orderpriority"], "o_orderkey").withColumn("which", F.lit("last")))


def label_override(spark, sf):
    long = _master(spark, sf).select("entity_key", "provider", "ordinal", "broad", "sub")
    k = F.right("name", F.lit(9)).cast("int")
    c = tables.listings(spark, sf).groupBy("name").agg(F.min("ordinal").alias("ordinal")).filter(k % 4 == 0)  # the labels of every fourth customer
    lab = c.select(X.key_squashed(F.col("name")).alias("entity_key"), "ordinal", F.when(k % 8 == 0, " ").otherwise("Labelled").alias("final_broad"), F.lit("Checked").alias("final_sub"))
    return labels.apply_labels(long, lab)


def review_queue(spark, sf):
    over = _summary(spark, sf).withColumn("broad_industry", F.when(F.col("broad_industry") == "MACHINERY", "Other / Unclassified").otherwise(F.col("broad_industry")))
    return labels.review_queue(over)


def provider_review(spark, sf):
    """review_queue() whose single ones are one provider's."""
    over = _summary(spark, sf).withColumn("broad_industry", F.when(F.col("broad_industry") == "MACHINERY", "Other / Unclassified").otherwise(F.col("broad_industry")))
    return labels.review_queue(over, provider="Urgent")


def labelled_summary(spark, sf):
    """The summary of listings whose industries come from labels where there are some."""
    long = _master(spark, sf)
    lab = long.groupBy("entity_key").agg(F.min("ordinal").alias("ordinal")).withColumns({"final_broad": F.when(F.col("ordinal") % 3 == 0, "Labelled").otherwise(" "), "final_sub": F.when(F.col("ordinal") % 2 == 0, "Checked")})
    return overlap.summary(labels.apply_labels(long, lab), PROVIDERS).select("entity_key", "provider_count", "broad_industry", "sub_industry")


_NAV, _INTERNAL = ["1996customer000000005", "1997customer000000010"], {"URGENT": ["1996customer000000004"], "LOW": ["1995customer000000004"]}


def exclusion_gates(spark, sf):
    x = tables.listings(spark, sf).select("ordinal", "name", "provider")
    gate = labels.gate(F.col("name"), F.col("provider"), _INTERNAL, {"HIGH": "1996customer0000001"}, _NAV)
    return x.withColumn("gate", F.coalesce(gate, F.lit("")))


def override_defaults(spark, sf):
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ["direct_public", "subsidiary_of_public", "private_no_public_match", "ambiguous", "acquired_or_delisted"])), (k % 5 + 1).cast("int"))
    review = F.when(k % 3 == 0, "").when(k % 3 == 1, "TRUE").otherwise("no")
    d = labels.override_result({"listing_status": status, "needs_listing_review": review, "listing_match_score": F.when(k % 2 == 0, "77.5"), "public_parent_name": F.col("o_clerk") if "o_clerk" in o.columns else F.lit("P"), "url": F.lit(" u ")})
    return o.select("o_orderkey", d.alias("d")).select("o_orderkey", "d.listing_status", "d.financial_data_available", "d.financial_data_level", "d.score", "d.confidence", "d.source_url", "d.source", "d.needs_review")


def brand_industries(spark, sf):
    """Brands' own industries for rows that bear their names, as they are written or as a search form."""
    k = F.col("c_custkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    name = F.when(k % 4 == 0, F.upper(F.lit(_BRANDS[0]))).when(k % 4 == 1, F.concat(F.lit(" "), F.lit(_BRANDS[1]), F.lit("!"))).otherwise(F.col("c_name"))
    found = {"broad": pick(brands.BRANDS[_BRANDS[0]][0], "Home", "Other / Unclassified"), "sub": F.lit(brands.BRANDS[_BRANDS[0]][1]), "confidence": pick("high", "high", "high", "low", "medium"), "reason": F.when(k % 7 != 0, "why"), "needs_review": k % 11 == 0}
    rows = read(spark, sf, "customer").select("c_custkey", name.alias("name"), *[c.alias(n) for n, c in found.items()])
    x = brands.overridden({n: F.col(n) for n in found}, F.col("name"), F.lit(None).cast("string"))
    return rows.select("c_custkey", x.alias("x")).select("c_custkey", "x.*")


_BRANDS = list(brands.BRANDS)[:2]


def brand_override(spark, sf):
    c = read(spark, sf, "customer").select(X.key_lower(F.col("c_name")).alias("entity_key"), F.col("c_mktsegment").alias("broad"), F.lit("General").alias("sub"), F.when(F.col("c_custkey") % 2 == 0, "high").otherwise("low").alias("confidence"))
    o = read(spark, sf, "customer").filter("c_acctbal < 0").select(X.key_lower(F.col("c_name")).alias("key"), F.lit("MACHINERY").alias("to_broad"), F.lit("General").alias("to_sub"))
    return labels.brand_override(c, o)


def override_template(spark, sf):
    x = _summary(spark, sf).withColumn("needs_review", F.col("provider_count") > 1)
    return labels.override_template(x)


def prefilled_labels(spark, sf):
    x = _summary(spark, sf).withColumn("broad_industry", F.when(F.col("broad_industry") == "MACHINERY", " Other / Unclassified ").otherwise(F.col("broad_industry")))
    return x.select("entity_key", labels.prefilled(F.col("broad_industry")).alias("final_broad"))


def metric_summary(spark, sf):
    return overlap.value_counts(read(spark, sf, "customer").withColumn("c_nationkey", F.when(F.col("c_nationkey") > 5, F.col("c_nationkey"))), ["c_mktsegment", "c_nationkey"])


def scalar_metrics(spark, sf):
    return overlap.metrics(
        _summary(spark, sf), entities=F.count(F.lit(1)), multi=F.count_if(F.col("provider_count") >= 2), high=F.count_if(F.col("provider_count") >= 3), industries=F.count_distinct("broad_industry"))


def unprocessed_keys(spark, sf):
    from ..streaming import resume

    o = read(spark, sf, "orders")
    done = o.filter("o_orderstatus = 'F'").select("o_custkey").distinct()
    return resume.pending(o.select("o_custkey", F.col("o_orderkey").alias("ordinal"), "o_totalprice"), done, "o_custkey")


def sanitised_text(spark, sf):
    from ..sources import bundle

    k = F.col("p_partkey") % 5
    lead = F.element_at(F.array(*map(F.lit, ["=", "+", "-", "@", ""])), (k + 1).cast("int"))
    return bundle.guarded(read(spark, sf, "part").select("p_partkey", F.concat(lead, F.col("p_name")).alias("p_name")))


def text_flags(spark, sf):
    k = F.col("o_orderkey") % 8
    text = F.element_at(F.array(*map(F.lit, ["TRUE", "1", " y", "1.0", "", "no", "T", "Yes "])), (k + 1).cast("int"))
    return read(spark, sf, "orders").select("o_orderkey", text.alias("flag"), X.truthy(text).alias("truth"), X.number(text, "double").alias("number"))


QUERIES = {
    "overlap_summary": (lambda s, d: overlap.in_order(_summary(s, d)), "WITH " + SUMMARY + " SELECT * FROM summary"),
    "overlap_alias_merged": (overlap_alias_merged, "WITH " + MERGED + " " + _MERGED_ROWS),
    "provider_membership": (provider_membership, "WITH " + SUMMARY + " SELECT entity_key, " + ", ".join(f"has_{overlap.column_name(p)} = 1 AS p{i}" if i < 2 else f"contains(lower(provider_set), '{p.lower()}') AS p{i}" for i, p in enumerate(PROVIDERS)) + " FROM summary"),
    "canonical_rows": (canonical_rows, "WITH " + LISTING + """, k AS (
  SELECT ordinal, CASE WHEN ordinal % 2 = 0 THEN upper(name) ELSE name END AS name, regexp_replace(lower(replace(name, ' ', '')), '[^a-z0-9]+', '', 'g') AS entity_key FROM listing
) SELECT ordinal, entity_key, name, canonical_name FROM k JOIN (SELECT entity_key, arg_min(name, (length(name), lower(name), name)) AS canonical_name FROM k GROUP BY 1) USING (entity_key)"""),
    "country_sets": (country_sets, """SELECT c_custkey, CASE WHEN n_name = 'UNITED STATES' THEN 'United States; United Kingdom' WHEN n_name = 'UNITED KINGDOM' THEN 'United Kingdom; United States'
  ELSE array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || '; United States; United Kingdom' END AS countries, ' UK' AS hint
FROM customer JOIN nation ON c_nationkey = n_nationkey"""),
    "friendly_names": (friendly_names, """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN n || ' Co' WHEN 1 THEN n || ' and Co' ELSE 'Oak' END AS name
FROM (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS n FROM part)"""),
    "ordered_distinct_union": (ordered_distinct_union, "WITH " + LISTING + """, e AS (
  SELECT name, ordinal, generate_subscripts(a, 1) AS p, trim(unnest(a)) AS item FROM (SELECT name, ordinal, regexp_split_to_array(provider || '; ' || lower(provider) || '; ' || sub || ',' || country, '[;|,]') AS a FROM listing)
), o AS (
  SELECT name, lower(item) AS low, arg_min(item, (ordinal, p)) AS item, min((ordinal, p)) AS at_ FROM e WHERE item <> '' GROUP BY name, lower(item)
) SELECT name, string_agg(item, '; ' ORDER BY at_) AS items FROM o GROUP BY name"""),
    "provider_matrix": (provider_matrix, "WITH " + MASTER + ", f AS (SELECT DISTINCT entity_key, provider FROM master) SELECT a.provider, " + ", ".join(f"count(*) FILTER (WHERE b.provider = '{p}') AS {overlap.column_name(p)}" for p in PROVIDERS) + " FROM f a JOIN f b USING (entity_key) GROUP BY a.provider"),
    "industry_by_provider_pivot": (lambda s, d: overlap.industry_pivot(_master(s, d), PROVIDERS), "WITH " + MASTER + ", p AS (SELECT broad AS broad_industry, " + ", ".join(f"count(DISTINCT entity_key) FILTER (WHERE provider = '{p}') AS {overlap.column_name(p)}" for p in PROVIDERS) + " FROM master GROUP BY broad) SELECT *, " + " + ".join(overlap.column_name(p) for p in PROVIDERS) + " AS total FROM p"),
    "industry_share": (lambda s, d: overlap.shares(_summary(s, d), "broad_industry"), "WITH " + SUMMARY + " SELECT broad_industry, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total, count(*) / sum(count(*)) OVER () AS share FROM summary GROUP BY broad_industry"),
    "industry_share_high": (industry_share_high, "WITH " + SUMMARY + " SELECT broad_industry, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total, count(*) / sum(count(*)) OVER () AS share FROM summary WHERE provider_count >= 3 GROUP BY broad_industry"),
    "industry_share_by_provider": (lambda s, d: overlap.shares(_master(s, d), "broad", ["provider"]), "WITH " + MASTER + " SELECT provider, broad, count(*) AS n, sum(count(*)) OVER (PARTITION BY provider)::BIGINT AS total, count(*) / sum(count(*)) OVER (PARTITION BY provider) AS share FROM master GROUP BY provider, broad"),
    "best_record_per_key": (best_record_per_key, "WITH " + LISTING + ", " + CLASSIFIED + " SELECT * FROM best"),
    "final_overlap_flags": (final_overlap_flags, "WITH " + SUMMARY + ", " + CLASSIFIED + """, j AS (
  SELECT s.entity_key, s.provider_count, b.entity_key IS NULL AS missing, coalesce(b.confidence, '') AS confidence, coalesce(b.review, '') AS review,
         CASE WHEN s.entity_key LIKE '%3' THEN CASE WHEN substr(s.entity_key, length(s.entity_key) - 1, 1) < '5' THEN 'Exclude - navigation' ELSE 'Exclude - provider internal' END ELSE coalesce(b.broad, '') END AS industry
  FROM summary s LEFT JOIN (SELECT * FROM best WHERE entity_key NOT LIKE '%7') b USING (entity_key)
) SELECT entity_key, provider_count, CASE WHEN missing THEN 'left_only' ELSE 'both' END AS merge_status, industry, industry LIKE 'Exclude%' AS is_excluded, industry NOT LIKE 'Exclude%' AS is_active,
         industry NOT LIKE 'Exclude%' AND provider_count >= 2 AS is_multi, industry NOT LIKE 'Exclude%' AND provider_count >= 3 AS is_high,
         industry NOT LIKE 'Exclude%' AND (review = 'TRUE' OR confidence = 'low' OR industry IN ('Other / Unclassified', '')) AS needs_review FROM j"""),
    "key_normalisation": (key_normalisation, _KEYS),
    "cache_key_sha1": (cache_key_sha1, "SELECT c_custkey, sha1(regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') || '||' || lower(n_name)) AS cache_key FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "modal_value": (modal_value, "SELECT l_partkey, m AS modal_flag FROM " + mode_sql("l_returnflag", "lineitem", "l_partkey")),
    "canonical_shortest_name": (canonical_shortest_name, "SELECT p_brand, arg_min(p_name, (length(p_name), lower(p_name), p_name)) AS name FROM part GROUP BY p_brand"),
    "first_and_last": (first_and_last, """SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, 'first' AS which FROM orders GROUP BY 1, 2
UNION ALL SELECT o_custkey, o_orderpriority, max(o_orderkey), arg_max(o_orderstatus, o_orderkey), 'last' FROM orders GROUP BY 1, 2"""),
    "label_override": (label_override, "WITH " + MASTER + """, l AS (SELECT DISTINCT entity_key, CASE WHEN CAST(right(entity_key, 9) AS INTEGER) % 8 = 0 THEN NULL ELSE 'Labelled' END AS b FROM master WHERE CAST(right(entity_key, 9) AS INTEGER) % 4 = 0)
SELECT m.entity_key, provider, ordinal, coalesce(b, broad) AS broad, CASE WHEN l.entity_key IS NULL THEN sub ELSE 'Checked' END AS sub, b IS NOT NULL AS labelled FROM master m LEFT JOIN l USING (entity_key)"""),
    "review_queue": (review_queue, "WITH " + SUMMARY + """, s AS (SELECT * FROM summary WHERE provider_count = 1 AND broad_industry = 'MACHINERY' ORDER BY canonical_name, entity_key LIMIT 500)
SELECT entity_key, canonical_name, provider_count, 'overlap' AS reason FROM summary WHERE provider_count >= 2 UNION ALL SELECT entity_key, canonical_name, provider_count, 'single_unclassified' FROM s"""),
    "provider_review": (provider_review, "WITH " + SUMMARY + """, s AS (SELECT * FROM summary WHERE provider_count = 1 AND broad_industry = 'MACHINERY' AND contains(lower(provider_set), 'urgent') ORDER BY canonical_name, entity_key LIMIT 500)
SELECT entity_key, canonical_name, provider_count, 'overlap' AS reason FROM summary WHERE provider_count >= 2 UNION ALL SELECT entity_key, canonical_name, provider_count, 'single_unclassified' FROM s"""),
    "labelled_summary": (labelled_summary, "WITH " + MASTER + f""", f AS (SELECT entity_key, min(ordinal) AS o FROM master GROUP BY 1
), l AS (
  SELECT entity_key, provider, CASE WHEN o % 3 = 0 THEN 'Labelled' ELSE broad END AS broad, CASE WHEN o % 2 = 0 THEN 'Checked' ELSE sub END AS sub FROM master JOIN f USING (entity_key)
) SELECT * FROM (SELECT entity_key, count(DISTINCT provider) AS provider_count FROM l GROUP BY 1) JOIN (SELECT entity_key, m AS broad_industry FROM {mode_sql('broad', 'l')}) USING (entity_key) JOIN (SELECT entity_key, m AS sub_industry FROM {mode_sql('sub', 'l')}) USING (entity_key)"""),
    "brand_industries": (brand_industries, f"""WITH r AS (
  SELECT c_custkey, c_custkey % 4 AS q, (['{brands.BRANDS[_BRANDS[0]][0]}', 'Home', 'Other / Unclassified'])[c_custkey % 3 + 1] AS broad, '{brands.BRANDS[_BRANDS[0]][1]}' AS sub, (['high', 'high', 'high', 'low', 'medium'])[c_custkey % 5 + 1] AS confidence,
         CASE WHEN c_custkey % 7 <> 0 THEN 'why' END AS reason, c_custkey % 11 = 0 AS needs_review FROM customer
), b AS (
  SELECT *, CASE q WHEN 0 THEN '{_BRANDS[0]}' WHEN 1 THEN '{_BRANDS[1]}' END AS k, CASE q WHEN 0 THEN '{brands.BRANDS[_BRANDS[0]][0]}' WHEN 1 THEN '{brands.BRANDS[_BRANDS[1]][0]}' END AS tb, CASE q WHEN 0 THEN '{brands.BRANDS[_BRANDS[0]][1]}' WHEN 1 THEN '{brands.BRANDS[_BRANDS[1]][1]}' END AS ts FROM r
), u AS (SELECT *, q < 2 AND NOT (broad = tb AND sub = ts AND confidence = 'high' AND NOT needs_review) AS use FROM b)
SELECT c_custkey, CASE WHEN use THEN tb ELSE broad END AS broad, CASE WHEN use THEN ts ELSE sub END AS sub, CASE WHEN use THEN 'high' ELSE confidence END AS confidence,
  CASE WHEN use THEN 'exact brand ' || k || '; before: ' || broad || ' / ' || sub || ' / ' || confidence || '; ' || coalesce(reason, '') ELSE reason END AS reason, CASE WHEN use THEN false ELSE needs_review END AS needs_review FROM u"""),
    "exclusion_gates": (exclusion_gates, "WITH " + LISTING + """ SELECT ordinal, name, provider, CASE
  WHEN (provider = 'URGENT' AND k = '1996customer000000004') OR (provider = 'LOW' AND k = '1995customer000000004') OR (provider = 'HIGH' AND k LIKE '1996customer0000001%') THEN 'internal'
  WHEN k IN ('1996customer000000005', '1997customer000000010') THEN 'nav' ELSE '' END AS gate FROM (SELECT *, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS k FROM listing)"""),
    "override_defaults": (override_defaults, """SELECT o_orderkey, s AS listing_status, (['yes', 'partial', 'no', 'unknown', 'unknown'])[k] AS financial_data_available, (['merchant_level', 'parent_level', 'none_public', 'unknown', 'unknown'])[k] AS financial_data_level,
  CASE WHEN o_orderkey % 2 = 0 THEN 77.5 ELSE 0.0 END::DOUBLE AS score, 'manual' AS confidence, 'u' AS source_url, 'manual_override' AS source, CASE o_orderkey % 3 WHEN 0 THEN k > 3 WHEN 1 THEN true ELSE false END AS needs_review
FROM (SELECT o_orderkey, o_orderkey % 5 + 1 AS k, (['direct_public', 'subsidiary_of_public', 'private_no_public_match', 'ambiguous', 'acquired_or_delisted'])[o_orderkey % 5 + 1] AS s FROM orders)"""),
    "brand_override": (brand_override, """SELECT regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS entity_key, CASE WHEN o THEN 'MACHINERY' ELSE c_mktsegment END AS broad, 'General' AS sub, CASE WHEN o OR c_custkey % 2 = 0 THEN 'high' ELSE 'low' END AS confidence, o AS overridden
FROM (SELECT *, c_acctbal < 0 AND NOT (c_mktsegment = 'MACHINERY' AND c_custkey % 2 = 0) AS o FROM customer)"""),
    "override_template": (override_template, "WITH " + SUMMARY + " SELECT entity_key, canonical_name, " + ", ".join(f"'' AS {c}" for c in labels.TEMPLATE) + " FROM summary WHERE provider_count > 1 ORDER BY entity_key LIMIT 500"),
    "prefilled_labels": (prefilled_labels, "WITH " + SUMMARY + " SELECT entity_key, CASE WHEN broad_industry = 'MACHINERY' THEN '' ELSE broad_industry END AS final_broad FROM summary"),
    "metric_summary": (metric_summary, "SELECT 'c_mktsegment' AS metric, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'c_nationkey', CASE WHEN c_nationkey > 5 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END, count(*) FROM customer GROUP BY 2"),
    "scalar_metrics": (scalar_metrics, "WITH " + SUMMARY + """ SELECT 'entities' AS metric, CAST(count(*) AS VARCHAR) AS value FROM summary UNION ALL SELECT 'multi', CAST(count(*) FILTER (WHERE provider_count >= 2) AS VARCHAR) FROM summary
UNION ALL SELECT 'high', CAST(count(*) FILTER (WHERE provider_count >= 3) AS VARCHAR) FROM summary UNION ALL SELECT 'industries', CAST(count(DISTINCT broad_industry) AS VARCHAR) FROM summary"""),
    "unprocessed_keys": (unprocessed_keys, "SELECT o_custkey, min(o_orderkey) AS ordinal, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY o_custkey"),
    "sanitised_text": (sanitised_text, "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '''=' WHEN 1 THEN '''+' WHEN 2 THEN '''-' WHEN 3 THEN '''@' ELSE '' END || p_name AS p_name FROM part"),
    "text_flags": (text_flags, "SELECT o_orderkey, f AS flag, lower(trim(f)) IN ('t', 'true', 'y', 'yes', '1') AS truth, coalesce(TRY_CAST(CASE WHEN f IN ('1', '1.0') THEN f END AS DOUBLE), 0) AS number FROM (SELECT o_orderkey, (['TRUE', '1', ' y', '1.0', '', 'no', 'T', 'Yes '])[o_orderkey % 8 + 1] AS f FROM orders)"),
}
