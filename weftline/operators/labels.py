"""Human labels, overrides, review queues and page gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import dedupe


def apply_labels(long: DataFrame, labels: DataFrame, key: str = "entity_key") -> DataFrame:
    """Overwrites broad and sub by the first non-blank label of an entity (ordinal, final_broad, final_sub), and tells which rows were."""
    one = dedupe.keep_first(labels, [key], "ordinal").select(key, F.nullif(F.trim("final_broad"), F.lit("")).alias("__b"), F.nullif(F.trim("final_sub"), F.lit("")).alias("__s"))
    out = long.join(one, key, "left")
    return out.withColumn("labelled", F.col("__b").isNotNull()).withColumn("broad", F.coalesce("__b", "broad")).withColumn("sub", F.coalesce("__s", "sub")).drop("__b", "__s")


def review_queue(over: DataFrame, most: int = 500, unclassified: str = "Other / Unclassified", provider: str | None = None) -> DataFrame:
    """Entities of two providers and more, and the first `most` by name of the unclassified ones of one provider; the former's reason wins, a key is there once.

    provider limits the latter to those whose provider_set holds it, in any case.
    """
    many = over.filter("provider_count >= 2").withColumns({"reason": F.lit("overlap"), "__place": F.lit(0)})
    single = over.filter((F.col("provider_count") == 1) & (F.trim("broad_industry") == unclassified))
    if provider is not None:
        single = single.filter(F.contains(F.lower(F.coalesce("provider_set", F.lit(""))), F.lit(provider.lower())))
    single = single.orderBy("canonical_name", "entity_key").limit(most).withColumns({"reason": F.lit("single_unclassified"), "__place": F.lit(1)})
    both = many.unionByName(single).select("entity_key", "canonical_name", "provider_count", "reason", "__place")
    return dedupe.best(both, ["entity_key"], [F.col("__place"), F.col("canonical_name")]).drop("__place")


def prefilled(label: Column, unclassified: str = "Other / Unclassified") -> Column:
    """What a reviewer finds filled in: the present label, but nothing for the unclassified."""
    return F.when(X.clean(label) == unclassified, "").otherwise(X.clean(label))


def gate(name: Column, provider: Column, internal: dict[str, list[str]], prefixes: dict[str, str], navigation: list[str]) -> Column:
    """`internal` for a provider's own pages (exact keys, or a prefix), `nav` for navigation pages, else null."""
    key = X.key_lower(name)
    out = F.when(key.isin(navigation), "nav")
    own = F.lit(False)
    for p, keys in internal.items():
        own = own | ((provider == p) & key.isin(keys))
    for p, prefix in prefixes.items():
        own = own | ((provider == p) & key.startswith(prefix))
    return F.when(own, "internal").otherwise(out)


def brand_override(df: DataFrame, overrides: DataFrame, key: str = "entity_key") -> DataFrame:
    """broad, sub and confidence from an exact brand key (key, to_broad, to_sub), unless the row has them with high confidence already."""
    o = overrides.select(F.col("key").alias(key), "to_broad", "to_sub")
    out = df.join(o, key, "left")
    same = (F.col("broad") == F.col("to_broad")) & (F.col("sub") == F.col("to_sub")) & (F.col("confidence") == "high")
    use = F.col("to_broad").isNotNull() & ~F.coalesce(same, F.lit(False))
    return (
        out.withColumn("overridden", use).withColumn("broad", F.when(use, F.col("to_broad")).otherwise(F.col("broad")))
        .withColumn("sub", F.when(use, F.col("to_sub")).otherwise(F.col("sub"))).withColumn("confidence", F.when(use, F.lit("high")).otherwise(F.col("confidence"))).drop("to_broad", "to_sub")
    )


#: Statuses that need review.
DOUBTFUL = ("ambiguous", "direct_public_candidate_needs_review", "subsidiary_public_candidate_needs_review", "acquired_or_delisted", "error")
_NONE = ("private_no_public_match", "no_public_match")


def overrides(rows: DataFrame, ordinal: str, legal: list[str]) -> DataFrame:
    """Manual overrides (all text) by merchant_key: rows with a status and a name, the last of a key; texts trimmed."""
    rows = rows.select(ordinal, *[X.strip_only(F.col(c)).alias(c) for c in rows.columns if c != ordinal])
    named = X.first_filled(*[F.col(c) for c in ("merchant_key", "clean_company_key", "merchant_name") if c in rows.columns])
    keyed = rows.filter("listing_status <> ''").withColumn("merchant_key", X.key_tokens(named, legal)).filter("merchant_key <> ''")
    return dedupe.keep_last(keyed, ["merchant_key"], ordinal)


def override_result(row: dict[str, Column]) -> Column:
    """Struct of the result that a manual override makes, what it leaves blank filled in by its status. row names its columns; those it lacks are blank."""
    of = lambda *names: X.first_filled(*[row[n] for n in names if n in row], F.lit(""))
    filled = lambda c, other: F.when(c != "", c).otherwise(other)
    status = filled(of("listing_status"), F.lit("unknown"))
    kind = lambda a, b, c: F.when(status == "direct_public", a).when(status == "subsidiary_of_public", b).when(status.isin(list(_NONE)), c).otherwise("unknown")
    same = ("public_company_name", "public_parent_name", "ticker", "exchange", "country_market", "cik")
    return F.struct(
        status.alias("listing_status"), filled(of("financial_data_available"), kind("yes", "partial", "no")).alias("financial_data_available"),
        filled(of("financial_data_level"), kind("merchant_level", "parent_level", "none_public")).alias("financial_data_level"),
        *[of(c).alias(c) for c in same],
        of("matched_entity_name", "public_company_name", "public_parent_name").alias("matched_entity_name"), filled(of("matched_entity_type"), F.lit("manual")).alias("matched_entity_type"),
        X.number(of("listing_match_score")).alias("score"), filled(of("listing_match_confidence"), F.lit("manual")).alias("confidence"), F.lit("manual_override").alias("method"),
        filled(of("listing_source"), F.lit("manual_override")).alias("source"), of("listing_source_url", "source_url", "url").alias("source_url"), of("listing_notes", "notes").alias("notes"),
        F.when(of("needs_listing_review") == "", status.isin(list(DOUBTFUL))).otherwise(F.lower(of("needs_listing_review")).isin("1", "true", "yes", "y")).alias("needs_review"),
    )


#: Columns of the override template besides key and name.
TEMPLATE = (
    "listing_status", "financial_data_available", "financial_data_level", "public_company_name", "public_parent_name", "ticker", "exchange", "country_market", "cik", "listing_match_confidence",
    "needs_listing_review", "source_url", "notes",
)


def override_template(results: DataFrame, most: int = 500) -> DataFrame:
    """Blank override rows for the first `most` results that need review, by key."""
    blank = [F.lit("").alias(c) for c in TEMPLATE]
    return results.filter("needs_review").orderBy("entity_key").limit(most).select("entity_key", "canonical_name", *blank)
