"""First, last and best of a group, as aggregations that combine before the shuffle: no sort of a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: str | None = None) -> DataFrame:
    """The row of each key that comes first in order (a tuple compared part by part, nulls first); size names a count."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("__best"), *([F.count(F.lit(1)).alias(size)] if size else []))
    return out.select(*[c if c in keys else F.col(f"__best.{c}").alias(c) for c in df.columns], *([size] if size else []))


def keep_first(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    return best(df, keys, [F.col(ordinal)])


def keep_last(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """The row of each key with the highest ordinal, a number or a text; a null ordinal is the lowest."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(ordinal).isNotNull(), F.col(ordinal))).alias("__best"))
    return out.select(*[c if c in keys else F.col(f"__best.{c}").alias(c) for c in df.columns])


def joined_set(df: DataFrame, keys: Sequence[str], items: Column, ordinal: str, out: str, sep: str = "; ") -> DataFrame:
    """For each key the items (an array in each row) once whatever their case, first spelling, in order of first sight.

    Items are reduced by key and item first, so what is gathered for a key is its distinct items only.
    """
    each = df.select(*keys, F.col(ordinal).alias("__o"), F.posexplode(items).alias("__p", "__item"))
    place = F.struct("__o", "__p")
    once = each.groupBy(*keys, F.lower("__item").alias("__low")).agg(F.min_by("__item", place).alias("__item"), F.min(place).alias("__at"))
    got = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__at", "__item"))).alias("__got"))
    return got.select(*keys, F.array_join(F.transform("__got", lambda x: x["__item"]), sep).alias(out))


def shortest_name(name: str) -> Column:
    """Aggregate: the shortest non-blank name, ties by lower case and then by code point."""
    n = F.when(F.col(name) != "", F.col(name))
    return F.min(F.when(n.isNotNull(), F.struct(F.length(n), F.lower(n), n.alias("n")))).getField("n")


def modal(c: Column, default: str = "") -> Column:
    """Aggregate: the commonest non-blank value, ties to the smallest."""
    return F.coalesce(F.mode(F.nullif(F.trim(c), F.lit("")), True), F.lit(default))


def sorted_set(c: Column, sep: str = "; ") -> Column:
    """Aggregate: distinct non-blank values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(F.nullif(c, F.lit("")))), sep)
