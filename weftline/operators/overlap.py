"""How entities overlap across providers: summaries, flags, matrices, pivots and shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import dedupe


def keyed(listings: DataFrame) -> DataFrame:
    """Listings with squashed names and a key, without blank keys."""
    return listings.filter(X.has_key(F.col("name"))).withColumns({"name": X.squash(F.col("name")), "entity_key": X.key_squashed(F.col("name"))})


def master(listings: DataFrame) -> DataFrame:
    """Listings (ordinal, name, provider, country, broad, sub, url) with a key, without blank keys, first of each (key, provider)."""
    return dedupe.keep_first(keyed(listings), ["entity_key", "provider"], "ordinal")


def with_canonical(long: DataFrame, key: str = "entity_key", name: str = "name") -> DataFrame:
    """long with the canonical name of each row's key."""
    return long.join(long.groupBy(key).agg(dedupe.shortest_name(name).alias("canonical_name")), key)


def summary(long: DataFrame, providers: Sequence[str]) -> DataFrame:
    """One row an entity: canonical name, variants, provider set and count, countries, modal industry, URLs, source files, 0/1 flags.

    An entity's distinct rows are gathered once for all its sets: in a master() there is one for each provider.
    """
    rows = F.collect_set(F.struct("name", "provider", "country", "url", "file"))
    found = long.groupBy("entity_key").agg(
        dedupe.shortest_name("name").alias("canonical_name"),
        rows.alias("__rows"),
        dedupe.modal(F.col("broad"), "Other / Unclassified").alias("broad_industry"),
        dedupe.modal(F.col("sub")).alias("sub_industry"),
        *[F.max(F.when(F.col("provider") == p, 1).otherwise(0)).alias("has_" + column_name(p)) for p in providers],
    )
    sorted_set = lambda c, sep="; ": X.joined_sorted(F.col(f"__rows.{c}"), sep)
    return found.select(
        "entity_key", "canonical_name",
        sorted_set("name", " | ").alias("name_variants"),
        sorted_set("provider").alias("provider_set"),
        F.size(F.array_compact(F.array_distinct("__rows.provider"))).cast("long").alias("provider_count"),
        sorted_set("country").alias("country_set"),
        "broad_industry", "sub_industry",
        sorted_set("url", " | ").alias("urls"),
        sorted_set("file").alias("files"),
        *["has_" + column_name(p) for p in providers],
    )


def in_order(entities: DataFrame) -> DataFrame:
    """Entities of many providers first, then by name."""
    return entities.orderBy(F.desc("provider_count"), "canonical_name", "entity_key")


def column_name(provider: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in provider.lower())


def matrix(long: DataFrame, providers: Sequence[str]) -> DataFrame:
    """provider, and for each provider the number of entities that both list; one scan, no cartesian product of rows."""
    flags = long.groupBy("entity_key").agg(*[F.max((F.col("provider") == p).cast("int")).alias(f"f{i}") for i, p in enumerate(providers)])
    cells = flags.agg(*[F.coalesce(F.sum(F.col(f"f{i}") * F.col(f"f{j}")), F.lit(0)).alias(f"c{i}_{j}") for i in range(len(providers)) for j in range(len(providers))])
    rows = F.array(*[F.struct(F.lit(p).alias("provider"), *[F.col(f"c{i}_{j}").cast("long").alias(column_name(q)) for j, q in enumerate(providers)]) for i, p in enumerate(providers)])
    return cells.select(F.explode(rows).alias("r")).select("r.*")


def industry_pivot(long: DataFrame, providers: Sequence[str]) -> DataFrame:
    """Distinct entities by industry and provider; the total sums the providers, so an entity on three counts thrice."""
    cols = [column_name(p) for p in providers]
    out = long.groupBy("broad").pivot("provider", list(providers)).agg(F.count_distinct("entity_key")).na.fill(0)
    out = out.toDF("broad_industry", *cols)
    return out.withColumn("total", sum((F.col(c) for c in cols), F.lit(0)).cast("long"))


def shares(df: DataFrame, by: str, within: Sequence[str] = ()) -> DataFrame:
    """Rows of each value of by (and within), and their share of the total (of within); blanks count as a value.

    The totals are joined back from the few counts, not windowed over all rows.
    """
    counts = df.groupBy(*within, by).agg(F.count(F.lit(1)).alias("n"))
    if within:
        total = counts.groupBy(*within).agg(F.sum("n").alias("total"))
        return counts.join(total, list(within)).withColumn("share", F.col("n") / F.col("total"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total"))  # total is one row


def merge_aliases(over: DataFrame, alias: DataFrame) -> DataFrame:
    """over with entity_key replaced by the key of the alias table's canonical name where it has one (alias_key, canonical)."""
    a = alias.select(F.col("alias_key").alias("entity_key"), X.key_plain(F.col("canonical")).alias("__to"))
    return over.join(a, "entity_key", "left").withColumn("entity_key", F.coalesce("__to", "entity_key")).drop("__to")


def has_provider(over: DataFrame, provider: str) -> Column:
    """Whether a row has a provider: by its flag column if there is one, else by the name's being in provider_set."""
    flag = "has_" + column_name(provider)
    if flag in over.columns:
        return X.truthy(F.col(flag))
    return F.contains(F.lower(X.clean(F.col("provider_set"))), F.lit(provider.lower()))


#: Columns whose delimited sets are united, and what they become.
UNITED = {"name_variants": "name_variants", "country_set": "countries", "urls": "urls", "files": "files"}

#: Keys up to this number are broadcast in a join.
FEW = 100_000


def aggregate_flags(over: DataFrame, providers: Sequence[str], exclusions: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Alias-merged entities: whether any row has a provider, how many and which, the shortest name, the united sets of the rows (in the
    order of in_order(); countries in one spelling), and the exclusion whose list of keys has the entity, blank for none.

    over is worked out once, at the call, and kept on the executors' disks as long as the result is in use. An entity of one row whose
    sets repeat no item is that row; only the others are taken apart and united.
    """
    found = {c: name for c, name in UNITED.items() if c in over.columns}
    has = {"has_" + column_name(p): has_provider(over, p) for p in providers}
    if found:
        out = _united(over, has, found)
    else:
        out = _merged(over.select("entity_key", "canonical_name", *[c.alias(n) for n, c in has.items()]), list(has))
    own = F.array_compact(F.array(*[F.when(F.col("has_" + column_name(p)), F.lit(p)) for p in providers]))
    kinds = [F.when(F.col("entity_key").isin(list(keys)), F.lit(kind)) for kind, keys in (exclusions or {}).items()]
    sums = [F.array_join(own, "; ").alias("providers"), F.size(own).cast("long").alias("provider_count"), F.coalesce(*kinds, F.lit("")).alias("exclusion")]
    return out.select("entity_key", "canonical_name", "merged_rows", *has, *sums, *found.values())


def _merged(rows: DataFrame, has: Sequence[str]) -> DataFrame:
    """Shortest name, number of rows and any row's flags for each key."""
    flags = [F.bool_or(c).alias(c) for c in has]
    return rows.groupBy("entity_key").agg(dedupe.shortest_name("canonical_name").alias("canonical_name"), F.count(F.lit(1)).alias("merged_rows"), *flags)


def _united(over: DataFrame, has: dict[str, Column], found: dict[str, str]) -> DataFrame:
    """_merged() of over with the united sets of found's columns."""
    items = {name: X.country_items(F.col(c)) if c == "country_set" else X.split_items(F.col(c)) for c, name in found.items()}
    place = F.struct(-F.col("provider_count"), F.col("canonical_name"), F.col("name_variants"))
    rows = over.select("entity_key", "canonical_name", place.alias("row"), *[c.alias(n) for n, c in has.items()], *[c.alias(n) for n, c in items.items()])
    rows = rows.localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)
    repeats = F.exists(F.array(*[F.size(n) > F.size(F.array_distinct(F.transform(n, F.lower))) for n in items]), lambda x: x)
    apart = rows.groupBy(F.col("entity_key").alias("__key")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(repeats).alias("r")).filter("n > 1 OR r").select("__key")
    apart = apart.localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)
    if apart.count() <= FEW:
        apart = F.broadcast(apart)
    on = F.col("entity_key").eqNullSafe(F.col("__key"))
    name = F.when(F.col("canonical_name") != "", F.col("canonical_name")).alias("canonical_name")
    alone = rows.join(apart, on, "left_anti").select("entity_key", name, F.lit(1).cast("long").alias("merged_rows"), *has, *[F.coalesce(F.array_join(n, "; "), F.lit("")).alias(n) for n in items])
    rows = rows.join(apart, on, "left_semi")
    sets = F.array(*[F.struct(F.lit(k).alias("set"), F.col(n).alias("items")) for k, n in enumerate(items)])
    each = rows.select("entity_key", "row", F.explode(sets).alias("s")).select("entity_key", "row", "s.set", F.posexplode("s.items").alias("place", "item"))
    at = F.struct("row", "place")
    once = each.groupBy("entity_key", "set", F.lower("item")).agg(F.min_by("item", at).alias("item"), F.min(at).alias("at"))
    joined = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("set") == k, F.struct("at", "item")))), lambda x: x["item"]), "; ").alias(n) for k, n in enumerate(items)]
    united = once.groupBy(F.col("entity_key").alias("__key")).agg(*joined)
    some = _merged(rows, list(has)).join(united, on, "left").drop("__key").na.fill("", list(items))
    return alone.unionByName(some)


#: How much a confidence and a status count when classifications of one key are compared; others count 0.
CONFIDENCE_SCORE = {"high": 3, "medium": 2, "low": 1}
STATUS_SCORE = {
    "official_website_verified": 4, "official_website_verified_plus_search_fallback": 3, "search_verified_website_unreachable": 2,
    "website_parse_failed_search_fallback": 2, "search_only_no_official_url": 1, "needs_manual_review": 0,
}


def best_classification(classified: DataFrame) -> DataFrame:
    """Per entity: filled before blank, other than excluded before excluded, then confidence, status, no review, first row.

    Of an entity without a filled row the first row stays, whatever else they say.
    """
    broad = X.clean(F.col("broad"))
    filled = lambda c: F.when(broad != "", c)
    score = lambda c, by: F.coalesce(F.create_map(*[F.lit(x) for kv in by.items() for x in kv])[c], F.lit(0))
    order = [
        (broad == "").cast("int"),
        filled(F.startswith(broad, F.lit("Exclude")).cast("int")),
        filled(-score(F.lower(X.clean(F.col("confidence"))), CONFIDENCE_SCORE)),
        filled(-score(X.clean(F.col("status")), STATUS_SCORE)),
        filled(X.truthy(F.col("review")).cast("int")),
        F.col("ordinal"),
    ]
    return dedupe.best(classified, ["entity_key"], order, "classified_rows")


def final(over: DataFrame, best: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Overlap joined with the chosen classification, exclusion overrides, and the flags that views filter by.

    A missing classification is `left_only`, unclassified and up for review, and doesn't count as excluded.
    """
    b = best.select("entity_key", "broad", "confidence", "review", F.lit(True).alias("__hit"))
    x = exclusions.select("entity_key", F.col("kind").alias("__kind"))
    out = over.join(b, "entity_key", "left").join(x, "entity_key", "left")
    broad = F.when(F.col("__kind") == "nav", "Exclude - navigation").when(F.col("__kind") == "internal", "Exclude - provider internal").otherwise(F.coalesce("broad", F.lit("")))
    out = out.withColumn("merge_status", F.when(F.col("__hit").isNull(), "left_only").otherwise("both")).withColumn("industry", broad)
    out = out.withColumn("is_excluded", F.startswith("industry", F.lit("Exclude")))
    out = out.withColumn("is_active", ~F.col("is_excluded")).withColumn("is_multi", F.col("is_active") & (F.col("provider_count") >= 2)).withColumn("is_high", F.col("is_active") & (F.col("provider_count") >= 3))
    review = X.truthy(F.col("review")) | (F.coalesce("confidence", F.lit("")) == "low") | (F.col("industry") == "Other / Unclassified") | (F.col("industry") == "")
    return out.withColumn("needs_review", F.col("is_active") & review).drop("__hit", "__kind", "broad")


def metrics(df: DataFrame, **named) -> DataFrame:
    """A tall table (metric, value as text) of aggregates over df, in one pass."""
    one = df.agg(*[c.cast("string").alias(k) for k, c in named.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in named])).alias("r")).select("r.*")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """metric, value and n of every value of some columns, blanks and nulls (as blanks) included."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns]))
    return df.select(pairs.alias("r")).groupBy("r.metric", "r.value").agg(F.count(F.lit(1)).alias("n"))
