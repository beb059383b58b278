"""Facts from nested JSON, and the choice of one fact for each entity, metric and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import dedupe

FACT = "struct<val:double,frame:string,form:string,filed:string,accn:string>"


def columnar_records(df: DataFrame, doc: str, keep: Sequence[str] = ()) -> DataFrame:
    """A map from field name to text for every record of JSON like {"fields": [...], "data": [[...], ...]}, its ordinal, and the columns in keep."""
    parsed = F.from_json(F.col(doc), "struct<fields:array<string>,data:array<array<string>>>")
    rows = df.select(*keep, parsed.alias("j")).select(*keep, F.posexplode("j.data").alias("ordinal", "row"), "j.fields")
    return rows.select(*keep, "ordinal", F.map_from_arrays("fields", F.slice("row", 1, F.size("fields"))).alias("record"))


def keyed_records(df: DataFrame, doc: str, record: str) -> DataFrame:
    """The values, of the given struct type, of a JSON object keyed by anything."""
    return df.select(F.explode(F.from_json(F.col(doc), f"map<string,{record}>")).alias("key", "r")).select("key", "r.*")


def company_facts(df: DataFrame, entity: str, doc: str, family: str = "us-gaap") -> DataFrame:
    """entity, tag, unit and fact columns of nested facts: family, tag, units, unit, list."""
    kind = f"struct<facts:map<string,map<string,struct<units:map<string,array<{FACT}>>>>>>"
    tags = df.select(entity, F.explode(F.from_json(F.col(doc), kind)["facts"][family]).alias("tag", "t"))
    units = tags.select(entity, "tag", F.explode("t.units").alias("unit", "rows"))
    return units.select(entity, "tag", "unit", F.explode("rows").alias("f")).select(entity, "tag", "unit", "f.*")


def usable(facts: DataFrame, forms: Sequence[str] = ("10-K", "10-K/A", "10-Q", "10-Q/A")) -> DataFrame:
    return facts.filter(F.col("val").isNotNull() & F.col("frame").isNotNull() & F.col("form").isin(list(forms)))


def by_period(facts: DataFrame, instant: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Quarterly and annual facts by their frames: CYyyyyQq (or with I) and CYyyyy; an instant metric's Q4 is its year's too."""
    f = facts.withColumns({
        "year": F.try_to_number(F.regexp_extract("frame", "^CY([0-9]{4})", 1), F.lit("9999")).cast("int"),
        "quarter": F.try_to_number(F.regexp_extract("frame", "^CY[0-9]{4}Q([1-4])I?$", 1), F.lit("9")).cast("int"),
    })
    quarterly = f.filter("quarter is not null")
    year_end = quarterly.filter(F.col("metric").isin(list(instant)) & (F.col("quarter") == 4))
    annual = f.filter(F.col("frame").rlike("^CY[0-9]{4}$")).unionByName(year_end).withColumn("quarter", F.lit(None).cast("int"))
    return quarterly, annual


def choose(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One fact for the keys: originals before amendments, then the last filed, the highest accession, the first tag."""
    rest = [c for c in facts.columns if c not in keys]
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rank = F.struct((~F.endswith(text("form"), F.lit("/A"))).alias("original"), text("filed").alias("filed"), text("accn").alias("accn"), (-F.col("tag_ordinal")).alias("tag"))
    one = facts.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__best"))
    return one.select(*[c if c in keys else F.col(f"__best.{c}").alias(c) for c in facts.columns])


def wide(facts: DataFrame, index: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row for the index, a value and a source tag column for each metric, in one pivot."""
    one = facts.groupBy(*index).pivot("metric", list(metrics)).agg(F.first("val").alias("value"), F.first("tag").alias("tag"))
    names = {f"{m}_value": m for m in metrics} | {f"{m}_tag": f"{m}_source" for m in metrics}
    return one.withColumnsRenamed(names)


def found_metrics(panel: DataFrame, entity: str, metrics: Sequence[str]) -> DataFrame:
    """entity and the metrics it has any value of, in the metrics' order."""
    has = [F.when(F.max(F.col(m)).isNotNull(), F.lit(m)) for m in metrics]
    return panel.groupBy(entity).agg(F.array_join(F.array_compact(F.array(*has)), "; ").alias("metrics_found"))


def counted_metrics(panel: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """metric and the number of rows that have it, zeros included, in one pass."""
    one = panel.agg(*[F.count(F.col(m)).alias(m) for m in metrics])
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("n")) for m in metrics])).alias("r")).select("r.*")


def audit(sample: DataFrame, tickers: DataFrame, fetched: DataFrame, found: DataFrame, entity: str = "entity") -> DataFrame:
    """A row for each entity (entity, ticker): cik, title, fetch_status and metrics_found.

    tickers maps ticker to cik and title; fetched has the ciks whose facts were read (cik, ok); found the metrics of each entity
    (metrics_found). Status: no_sec_ticker_match, fetch_error (not fetched, or not ok), or ok.
    """
    t = tickers.select(F.col("ticker").alias("__t"), "cik", "title")
    f = fetched.groupBy(F.col("cik").alias("__c")).agg(F.bool_or("ok").alias("ok"))
    out = sample.withColumn("__m", X.ticker(F.col("ticker"))).join(t, F.col("__m") == F.col("__t"), "left").join(f, F.col("cik") == F.col("__c"), "left").join(found, entity, "left")
    status = F.when(F.col("cik").isNull(), "no_sec_ticker_match").when(F.coalesce("ok", F.lit(False)), "ok").otherwise("fetch_error")
    return out.select(entity, "ticker", "cik", F.coalesce("title", F.lit("")).alias("title"), status.alias("fetch_status"), F.when(status == "ok", F.coalesce("metrics_found", F.lit(""))).otherwise("").alias("metrics_found"))
