"""Decision cascades over columns that are worked out beforehand: URL discovery, classification status, listing status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import labels


def discover(own: Column, listed: Column, on_page: Column, searched: Column, provider_domains: Sequence[str]) -> Column:
    """Struct (url, method): a redirect's target, an own URL that isn't the provider's, a link of the provider's page, a search result.

    listed is an array of URLs, on_page and searched the best link of each kind or null.
    """
    target = F.nullif(X.redirect_target(own), F.lit(""))
    foreign = F.try_element_at(F.filter(listed, lambda u: X.is_http(u) & ~X.within_domains(X.domain(u), provider_domains)), F.lit(1))
    found = [(target, "redirect"), (foreign, "existing"), (on_page, "provider_page"), (searched, "search")]
    return F.coalesce(*[F.when(u.isNotNull(), F.struct(u.alias("url"), F.lit(m).alias("method"))) for u, m in found], F.struct(F.lit("").alias("url"), F.lit("none").alias("method")))


def known_urls(*columns: Column) -> Column:
    """Distinct http URLs of some columns, each a list split at |."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(c, F.lit("")), "\\|") for c in columns]))
    return F.array_distinct(F.filter(F.transform(parts, X.clean), X.is_http))


#: The statuses of a classification by how it came about, and what an excluded row is called.
INTERNAL, NAVIGATION = ("exclude_provider_internal_page", "Exclude / BNPL Internal Page"), ("exclude_non_merchant_page", "Exclude / Non-Merchant Page")
NO_NAME, NO_URL, UNREACHABLE, UNPARSED = "unable_to_verify", "search_only_no_official_url", "search_verified_website_unreachable", "website_parse_failed_search_fallback"
VERIFIED, VERIFIED_BY_SEARCH, MANUAL = "official_website_verified", "official_website_verified_plus_search_fallback", "needs_manual_review"
OTHER = "Other / Unclassified"


def classification(gate: Column, name: Column, url: Column, fetched: Column, parsed: Column, page: tuple[Column, Column], search: tuple[Column, Column], both: tuple[Column, Column] | None = None) -> Column:
    """Struct (status, broad, confidence, review) of the state machine; page, search and both are (broad, confidence) of the evidence used.

    Without a page the search evidence alone counts. An unclassified or low page gives way to page and search together (both;
    search unless given) if that has a class, and the page had none or the new confidence is not low.
    """
    both = both or search
    state = lambda s, b, c, r: F.struct(F.lit(s).alias("status") if isinstance(s, str) else s.alias("status"), b.alias("broad"), c.alias("confidence"), r.alias("review"))
    other, yes, no = F.lit(OTHER), F.lit(True), F.lit(False)
    doubt = lambda x: F.coalesce((x[1] == "low") | (x[0] == OTHER), yes)
    by_search = lambda s, r: state(s, F.coalesce(search[0], other), F.coalesce(search[1], F.lit("low")), r)
    better = doubt(page) & (both[0] != OTHER) & ((page[0] == OTHER) | both[1].isin("medium", "high"))
    return (
        F.when(gate == "internal", state(INTERNAL[0], F.lit(INTERNAL[1]), F.lit("high"), no))
        .when(gate == "nav", state(NAVIGATION[0], F.lit(NAVIGATION[1]), F.lit("high"), no))
        .when(X.clean(name) == "", state(NO_NAME, other, F.lit("low"), yes))
        .when(X.clean(url) == "", by_search(NO_URL, doubt(search)))
        .when(~F.coalesce(fetched, no), by_search(UNREACHABLE, doubt(search)))
        .when(~F.coalesce(parsed, no), by_search(UNPARSED, yes))
        .when(F.coalesce(better, no), state(VERIFIED_BY_SEARCH, both[0], both[1], doubt(both)))
        .otherwise(state(F.when(page[0] != OTHER, VERIFIED).otherwise(MANUAL), page[0], page[1], doubt(page)))
    )


def entity_score(name_score: Column, own_domain: Column, entity_domain: Column) -> Column:
    """A name score with ten points for the same domain, 100 at most; null for none."""
    return F.when(name_score.isNotNull(), F.least(F.lit(100.0), name_score + F.when((own_domain != "") & (own_domain == entity_domain), 10.0).otherwise(0.0)))


def parents(edges: DataFrame, most: int = 4) -> DataFrame:
    """entity and its first `most` owners (ordinal, parent), each once: one hop. Ranks over `most` are dropped before the shuffle."""
    first = edges.withColumn("__r", F.dense_rank().over(W.partitionBy("entity").orderBy("ordinal", "parent"))).filter(F.col("__r") <= most)
    return first.select("entity", "ordinal", "parent").distinct().select("entity", "parent")


def listing_status(name: Column, override: Column, direct: Column, firm: Column, entity: Column, parent: Column, private: bool = False) -> Column:
    """Struct (status, confidence, review) from the best scores of each source (null for none); the first step that holds decides.

    A direct match of 86 and more, an entity's own ticker under 94 and a public parent under 90 are candidates for review. No
    match asks for review too, unless private says that it counts as private.
    """
    step = lambda s, c, r: F.struct((F.lit(s) if isinstance(s, str) else s).alias("status"), c.alias("confidence"), r.alias("review"))
    level = lambda s: F.when(s >= 96, "high").when(s >= 88, "medium").otherwise("low")
    yes, no, low = F.lit(True), F.lit(False), F.lit("low")
    doubt = "direct_public_candidate_needs_review"
    best = F.greatest(*[F.coalesce(c, F.lit(0.0)) for c in (direct, entity, parent)])
    return (
        F.when(X.clean(name) == "", step("error", low, yes))
        .when(F.coalesce(override, F.lit("")) != "", step(override, F.lit("manual"), override.isin(list(labels.DOUBTFUL))))
        .when(F.coalesce(firm & (direct >= 94), no), step("direct_public", level(direct), direct < 96))
        .when(F.coalesce(direct >= 86, no), step(doubt, level(direct), yes))
        .when(F.coalesce(entity >= 88, no), step(F.when(entity >= 94, "direct_public").otherwise(doubt), level(entity), entity < 94))
        .when(F.coalesce(parent >= 82, no), step(F.when(parent >= 90, "subsidiary_of_public").otherwise("subsidiary_public_candidate_needs_review"), level(parent), parent < 90))
        .when(best >= 75, step("ambiguous", level(best), yes))
        .otherwise(step("private_no_public_match", low, no) if private else step("no_public_match", low, yes))
    )
