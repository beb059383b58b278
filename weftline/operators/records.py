"""Reference records from landed JSON: exchange tables, ticker maps, quote searches, and entities with their claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import dedupe, facts

# What the names of securities that are no operating company hold.
NON_OPERATING = [
    " etf", " etn", " fund", " trust", " income shares", " enhanced high income", " cdr", " cad hedged", " hedged", " tracker", " trackx", " warrant", " warrants", " certificate", " certificates",
    " note", " notes", " bond", " bonds", " units", " unit", " option", " options", " bull ", " bear ",
]
# How good a market an exchange is, 0 the best.
EXCHANGE_RANK = {
    "NASDAQ": 0, "NasdaqGS": 0, "NasdaqGM": 0, "NYSE": 0, "NYSEArca": 1, "XETRA": 1, "London": 1, "London Stock Exchange": 1, "Tokyo Stock Exchange": 1, "Toronto": 2, "Swiss": 2, "Frankfurt": 3,
    "Vienna": 4, "Munich": 4, "Stuttgart": 4, "Mexico": 4, "Buenos Aires": 4, "Sao Paulo": 4, "São Paulo": 4, "SET": 4,
}
# Words of company names that say nothing of the company.
LEGAL = [
    "inc", "incorporated", "corp", "corporation", "co", "company", "companies", "ltd", "limited", "llc", "com", "plc", "holdings", "holding", "sa", "ag", "nv", "se", "spa", "ab", "oyj", "kk", "pte",
    "gmbh", "sarl", "bv", "asa", "as",
]
# Words of names that tell no company from another.
GENERIC = ["shop", "store", "official", "online", "usa", "us", "uk", "the", "and", "of", "for"]
# Properties of an entity.
TICKER, EXCHANGE, PARENT, OWNER, SITE = "P249", "P414", "P749", "P127", "P856"


def non_operating(name: Column, terms: Sequence[str] = NON_OPERATING) -> Column:
    """True for the name of a security that is no operating company: a term is in the name with a blank at each end."""
    return X.contains_any(F.concat(F.lit(" "), F.lower(X.strip_only(name)), F.lit(" ")), terms)


def market_rank(exchange: Column, ticker: Column) -> Column:
    """The exchange's rank; of others 2 for a ticker without a dot and 5 with one."""
    known = F.create_map(*[F.lit(x) for pair in EXCHANGE_RANK.items() for x in pair])[X.strip_only(exchange)]
    return F.coalesce(known, F.when(F.contains(X.strip_only(ticker), F.lit(".")), 5).otherwise(2))


def exchange_records(df: DataFrame, doc: str, keep: Sequence[str] = ()) -> DataFrame:
    """name, ticker, exchange, cik (ten digits) and alias of the records of a columnar table that have a name and a ticker, and the columns in keep.

    The alias is the name up to a dash between blanks.
    """
    r = facts.columnar_records(df, doc, keep)
    of = lambda f: X.strip_only(F.col("record")[f])
    rows = r.select(*keep, "ordinal", of("name").alias("name"), of("ticker").alias("ticker"), of("exchange").alias("exchange"), of("cik").alias("cik"))
    rows = rows.filter("name <> '' and ticker <> ''").withColumn("cik", F.when(F.col("cik") != "", F.lpad("cik", 10, "0")).otherwise(""))
    return rows.withColumn("alias", X.strip_only(F.regexp_replace("name", "(?U)\\s+-\\s+.*$", "")))


def ticker_map(df: DataFrame, doc: str) -> DataFrame:
    """cik, ticker (upper case) and title of a JSON object of records keyed by a number; the first of a ticker by that number."""
    r = facts.keyed_records(df, doc, "struct<cik_str:long,ticker:string,title:string>")
    rows = r.select(F.col("cik_str").alias("cik"), F.upper("ticker").alias("ticker"), "title", F.col("key").try_cast("long").alias("__n"))
    return dedupe.keep_first(rows.filter("ticker is not null"), ["ticker"], "__n").drop("__n")


_QUOTE = "struct<quoteType:string,typeDisp:string,symbol:string,longname:string,shortname:string,exchDisp:string,exchange:string,market:string>"


def quote_records(df: DataFrame, key: str, doc: str, ordinal: str) -> DataFrame:
    """key, name, ticker, exchange, market and aliases of the quotes in searches' answers: equities or untyped, with a symbol and a name, of
    operating companies; of those with one ticker and name key the last by the search's ordinal and the quote's place."""
    q = df.select(key, F.col(ordinal).alias("__o"), F.posexplode(F.from_json(doc, f"struct<quotes:array<{_QUOTE}>>")["quotes"]).alias("__p", "q"))
    kind = F.upper(X.strip_only(F.coalesce("q.quoteType", "q.typeDisp")))
    name = X.first_filled(F.col("q.longname"), F.col("q.shortname"))
    rows = q.select(
        key, "__o", "__p", kind.alias("kind"), name.alias("name"), X.strip_only(F.col("q.symbol")).alias("ticker"), X.first_filled(F.col("q.exchDisp"), F.col("q.exchange")).alias("exchange"),
        X.strip_only(F.col("q.market")).alias("market"), X.filled(F.col("q.shortname"), F.col("q.longname")).alias("aliases"), X.key_tokens(name, LEGAL).alias("__k"),
    )
    rows = rows.filter((F.col("kind").isin("", "EQUITY")) & (F.col("ticker") != "") & (F.col("name") != "") & ~non_operating(F.col("name")))
    return dedupe.best(rows, [key, "ticker", "__k"], [-F.col("__o"), -F.col("__p")]).drop("__o", "__p", "__k", "kind")


_ENTITY = "struct<labels:map<string,struct<value:string>>,aliases:map<string,array<struct<value:string>>>,claims:map<string,array<struct<mainsnak:struct<datavalue:struct<value:variant>>>>>>"


def entities(df: DataFrame, id_col: str, doc: str) -> DataFrame:
    """id and entity (a struct of labels, aliases and claims) of landed JSON {"entities": {id: {...}}}; null where that isn't there."""
    return df.select(id_col, F.from_json(doc, f"struct<entities:map<string,{_ENTITY}>>")["entities"][F.col(id_col)].alias("entity"))


def label(entity: Column) -> Column:
    """The English label, else the multilingual one, else the first; blank for none."""
    of = entity["labels"]
    return X.clean(F.coalesce(of["en"]["value"], of["mul"]["value"], F.try_element_at(F.map_values(of), F.lit(1))["value"]))


def aliases(entity: Column) -> Column:
    """English and then multilingual aliases that aren't blank."""
    of = lambda lang: F.coalesce(F.transform(entity["aliases"][lang], lambda a: X.clean(a["value"])), F.array().cast("array<string>"))
    return F.filter(F.concat(of("en"), of("mul")), lambda x: x != "")


def claims(entity: Column, prop: str) -> Column:
    """The values, as variants, of a property."""
    values = F.transform(entity["claims"][prop], lambda c: c["mainsnak"]["datavalue"]["value"])
    return F.coalesce(F.filter(values, lambda v: v.isNotNull() & ~F.is_variant_null(v)), F.array().cast("array<variant>"))


def claim_strings(entity: Column, prop: str) -> Column:
    """The values of a property that are texts."""
    texts = F.filter(claims(entity, prop), lambda v: F.schema_of_variant(v) == "STRING")
    return F.transform(texts, lambda v: X.clean(F.try_variant_get(v, "$", "string")))


def claim_ids(entity: Column, prop: str) -> Column:
    """The ids of the entities that a property names."""
    return F.filter(F.transform(claims(entity, prop), lambda v: F.try_variant_get(v, "$.id", "string")), lambda x: x.isNotNull())


def entity_matches(scored: DataFrame, found: DataFrame, key: str, id_col: str, url: str, direct: float = 75.0, parent: float = 70.0, most: int = 4) -> DataFrame:
    """key, id, score, method, ticker and name of the public companies behind search hits, directly and by one hop to a parent.

    scored has key, id, the best name score over label and aliases, and the key's url; found has every landed entity. The same
    domain as an official site adds ten points, to 100. An entity with a ticker counts from `direct` points on, the first
    `most` parents and owners with one from `parent` points of the child on.
    """
    of = lambda prop: claim_strings(F.col("entity"), prop)
    ticker = F.try_element_at(of(TICKER), F.lit(1))
    facts_ = found.filter("entity is not null").select(
        F.col(id_col).alias("__id"), label(F.col("entity")).alias("name"), ticker.alias("ticker"), F.transform(of(SITE), X.domain).alias("__sites"),
        F.slice(F.concat(claim_ids(F.col("entity"), PARENT), claim_ids(F.col("entity"), OWNER)), 1, most).alias("__up"),
    )
    hits = scored.join(facts_, scored[id_col] == facts_["__id"]).withColumn("__own", X.domain(F.col(url)))
    more = (F.col("__own") != "") & F.array_contains("__sites", F.col("__own"))
    hits = hits.withColumn("score", F.least(F.lit(100.0), F.col("score") + F.when(more, 10.0).otherwise(0.0)))
    one = hits.filter(F.col("ticker").isNotNull() & (F.col("score") >= direct)).select(key, F.col("__id").alias("id"), "score", F.lit("wikidata_direct_ticker").alias("method"), "ticker", "name")
    up = hits.filter(F.col("score") >= parent).select(key, "score", F.explode(F.array_distinct("__up")).alias("id"))
    two = up.join(facts_.filter("ticker is not null").select(F.col("__id").alias("id"), "ticker", "name"), "id").select(key, "id", "score", F.lit("wikidata_public_parent").alias("method"), "ticker", "name")
    return one.unionByName(two)
