"""Binding of loosely named input columns to a declared schema."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A logical column: its physical names in order of preference, its type, and what stands in if none is there."""

    name: str
    candidates: tuple[str, ...]
    kind: str = "string"
    default: object = None
    required: bool = False


def header(name: str) -> str:
    return re.sub(r"[\s-]", "_", name.strip().lower())


def tidy_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[header(c) for c in df.columns])


def bind(df: DataFrame, fields: list[Field]) -> DataFrame:
    """One column for each field, of the field's type; raises if a required one has no candidate in df."""
    out = []
    for f in fields:
        found = next((c for c in f.candidates if c in df.columns), None)
        if found is None and f.required:
            raise ValueError(f"none of {f.candidates} is among {df.columns}")
        out.append((F.lit(f.default) if found is None else F.col(f"`{found}`")).cast(f.kind).alias(f.name))
    return df.select(out)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def backfill(df: DataFrame, columns: dict[str, object]) -> DataFrame:
    """df with the columns that it lacks, as constants."""
    return df.withColumns({c: F.lit(v) for c, v in columns.items() if c not in df.columns})


def ordered(df: DataFrame, first: list[str], drop_prefix: str = "premerge_") -> DataFrame:
    """The named columns first, the others after them; columns with a working prefix go."""
    rest = [c for c in df.columns if c not in first and not c.startswith(drop_prefix)]
    return df.select(*first, *rest)
