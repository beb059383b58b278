"""Public companies behind the names of search hits: hits, entities, scores and parents in one operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import matching, records

#: Hits of a search, exchanges and parents of an entity that count, least points of both kinds.
HITS, EXCHANGES, PARENTS, DIRECT, PARENT = 3, 3, 4, 75.0, 70.0
#: What the same domain adds.
DOMAIN = 10.0


def search_hits(df: DataFrame, key: str, doc: str, most: int = HITS) -> DataFrame:
    """key, rank and id of the first hits of landed search results {"search": [{"id": ...}, ...]}; a hit without an id counts among the first, and is left out."""
    hits = F.slice(F.from_json(F.col(doc), "struct<search:array<struct<id:string>>>")["search"], 1, most)
    rows = df.select(key, F.posexplode(hits).alias("rank", "hit"))
    return rows.select(key, "rank", X.clean(F.col("hit.id")).alias("id")).filter("id <> ''")


def facts(found: DataFrame, id_col: str) -> DataFrame:
    """id, name, aliases, ticker (the first), exchange (labels of the first exchanges that have landed), sites and parents of landed entities."""
    e = F.col("entity")
    of = lambda prop: records.claim_strings(e, prop)
    one = found.filter("entity is not null").select(
        F.col(id_col).alias("id"), records.label(e).alias("name"), records.aliases(e).alias("aliases"), F.try_element_at(of(records.TICKER), F.lit(1)).alias("ticker"),
        F.filter(F.transform(of(records.SITE), X.domain), lambda d: d != "").alias("sites"),
        F.slice(F.concat(records.claim_ids(e, records.PARENT), records.claim_ids(e, records.OWNER)), 1, PARENTS).alias("parents"), F.slice(records.claim_ids(e, records.EXCHANGE), 1, EXCHANGES).alias("__x"),
    ).dropDuplicates(["id"])
    names = one.select(F.col("id").alias("__e"), F.col("name").alias("__n")).filter("__n <> ''")
    listed = one.filter("ticker is not null").select("id", F.posexplode("__x").alias("__p", "__e")).join(names, "__e")
    labels = listed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("__p", "__n"))).alias("__l"))  # EXCHANGES rows at most
    out = one.drop("__x").join(labels, "id", "left")
    return out.withColumn("exchange", F.coalesce(F.array_join(F.transform("__l", lambda x: x["__n"]), "; "), F.lit(""))).drop("__l")


def name_scores(asked: DataFrame, hits: DataFrame, known: DataFrame, key: str, name: str, legal: Sequence[str], generic: Sequence[str], least: float) -> DataFrame:
    """key, id and the best score of the asked name over an entity's label and aliases; exact from least on."""
    left = matching.prepared(asked.select(key, name), name, legal, generic, "l_")
    names = F.array_distinct(F.filter(F.concat(F.array("name"), "aliases"), lambda x: x != ""))
    right = matching.prepared(known.select("id", F.explode(names).alias("__name")), "__name", legal, generic, "r_")
    pairs = hits.select(key, "id").distinct().join(left, key).join(right, "id")
    return matching.score(pairs, least).groupBy(key, "id").agg(F.max("score").alias("score"))


def candidates(asked: DataFrame, hits: DataFrame, found: DataFrame, key: str, name: str, url: str, id_col: str, legal: Sequence[str] = records.LEGAL, generic: Sequence[str] = records.GENERIC) -> DataFrame:
    """key, id, via, score, method, entity_type, name, ticker and exchange of the public companies behind each asked name.

    asked has a row for each key; hits are search_hits(); found has every landed entity (records.entities()). The score is the
    best over label and aliases, ten points more if the asked url's domain is one of the entity's sites, 100 at most. An entity
    with a ticker counts from DIRECT on; its first parents and owners with a ticker, each once, from PARENT on, whatever their
    own names. via is the entity that was found. Hits that haven't landed, and names without hits, give no rows.
    """
    known = facts(found, id_col)
    scored = name_scores(asked, hits, known, key, name, legal, generic, min(DIRECT, PARENT) - DOMAIN)
    own = asked.select(key, X.domain(F.col(url)).alias("__own"))
    more = (F.col("__own") != "") & F.array_contains("sites", F.col("__own"))
    x = scored.join(own, key).join(known.drop("name", "aliases"), "id").withColumn("score", F.least(F.lit(100.0), F.col("score") + F.when(more, DOMAIN).otherwise(0.0)))
    companies = known.filter("ticker is not null").select("id", "name", "ticker", "exchange")
    out = lambda df, method, kind: df.select(key, "id", "via", "score", F.lit(method).alias("method"), F.lit(kind).alias("entity_type"), "name", "ticker", "exchange")
    direct = x.filter(F.col("ticker").isNotNull() & (F.col("score") >= DIRECT)).select(key, "id", F.col("id").alias("via"), "score").join(companies, "id")
    up = x.filter(F.col("score") >= PARENT).select(key, F.col("id").alias("via"), "score", F.explode(F.array_distinct("parents")).alias("id")).join(companies, "id")
    return out(direct, "wikidata_direct_ticker", "wikidata_entity").unionByName(out(up, "wikidata_public_parent", "public_parent"))


def best_scores(found: DataFrame, key: str) -> DataFrame:
    """key and the best score of each method (entity and parent), as cascade.listing_status() takes them."""
    best = lambda method: F.max(F.when(F.col("method") == method, F.col("score")))
    return found.groupBy(key).agg(best("wikidata_direct_ticker").alias("entity"), best("wikidata_public_parent").alias("parent"))


def first_of(found: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The best candidate of each key: highest score, then order, in one aggregation."""
    rank = F.struct((-F.col("score")).alias("s"), *[c.alias(f"o{k}") for k, c in enumerate(order)], F.col("id").alias("i"))
    rest = [c for c in found.columns if c != key]
    return found.groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("b")).select(key, "b.*")
