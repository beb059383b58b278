"""Adoption evidence, event alignment, outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions import text as X
from . import dedupe

#: Strengths of evidence that can't confirm an adoption.
UNCONFIRMABLE = ("planned_not_final_adoption", "expansion_not_initial", "not_merchant_adoption", "strong_non_us")
#: Audit statuses of the core sample, and of a match that is none; exchanges whose companies report facts.
CORE = ("confirmed_or_manually_mapped_public", "auto_public_match_needs_light_review")
FALSE_MATCH = "exclude_false_public_match"
REPORTING = ("NASDAQ", "NYSE", "NYSE ADR", "OTC Markets")


def confirmable(strength: Column, excluded: Sequence[str] = UNCONFIRMABLE) -> Column:
    """A missing strength counts as confirmable."""
    return ~F.coalesce(strength, F.lit("")).isin(list(excluded))


def earliest(evidence: DataFrame, key: str) -> DataFrame:
    """The earliest confirmable evidence (date, strength, provider, ordinal) of each key."""
    return dedupe.best(evidence.filter(confirmable(F.col("strength")) & F.col("date").isNotNull()), [key], [F.col("date"), F.col("strength"), F.col("provider"), F.col("ordinal")])


def notes(evidence: DataFrame, key: str, line: Column) -> DataFrame:
    """key and all its evidence lines by date and provider, joined."""
    return ordered.joined(evidence, key, ["date", "provider", "ordinal"], line, "note", " | ")


def core(rows: DataFrame, status: str) -> DataFrame:
    """Rows of the core sample."""
    return rows.filter(F.coalesce(F.col(status).isin(list(CORE)), F.lit(False)))


def sample_flags(listing: Column, level: Column, audited: Column, exchange: Column) -> dict[str, Column]:
    """Flags of the main sample, of the robustness sample of parents, and of companies that may report facts; a missing audit status is no false match."""
    sound = F.coalesce(audited != FALSE_MATCH, F.lit(True))
    both = lambda a, b: F.coalesce((listing == a) & (level == b), F.lit(False)) & sound
    return {"sample_main": both("direct_public", "merchant_level"), "sample_parent": both("subsidiary_of_public", "parent_level"), "reports": F.coalesce(exchange.isin(list(REPORTING)), F.lit(False))}


def joined_sample(adoption: DataFrame, public: DataFrame, left_key: str, right_key: str, keep: Sequence[str]) -> DataFrame:
    """adoption with the columns in keep of the public companies whose key, of another name, is the same; rows without one stay, and repeated keys repeat rows."""
    taken = [c for c in keep if c in adoption.columns]
    if taken:
        raise ValueError(f"both sides have {taken}")
    right = public.select(F.col(right_key).alias("__key"), *keep)
    return adoption.join(right, adoption[left_key] == F.col("__key"), "left").drop("__key")


def sample(df: DataFrame, date: Column) -> DataFrame:
    """Rows with an adoption date: year, quarter, index, window years."""
    d = df.withColumn("adoption_date", date).filter("adoption_date is not null")
    a = F.col("adoption_date")
    return d.withColumns({
        "adoption_year": F.year(a).cast("long"), "adoption_quarter": X.quarter_label(a), "adoption_index": X.quarter_index(a),
        "window_start": (F.year(a) - 10).cast("long"), "window_end": (F.year(a) + 10).cast("long"),
    })


def align(panel: DataFrame, events: DataFrame, entity: str, period: str, width: int) -> DataFrame:
    """panel joined with each entity's event index: event_time, post, rows within width periods of the event."""
    out = panel.join(events.select(entity, "event_index"), entity, "left")
    out = out.withColumn("event_time", F.col(period) - F.col("event_index")).withColumn("post", F.coalesce((F.col("event_time") >= 0).cast("int"), F.lit(0)))
    return out.filter(F.col("event_time").between(-width, width))


def outcomes(panel: DataFrame, entity: str, period: str, lag: int, calendar: bool = False) -> DataFrame:
    """Margins, shares, logs, and growth against the row `lag` rows before (of the period `lag` before, if calendar).

    A zero or missing denominator gives null. Growth of operating income is x / |lag| - 1. Lags are by entity, whose periods
    are few; a panel has one row an entity and period.
    """
    rev = F.col("revenue")
    out = panel.withColumns({
        "gross_margin": F.try_divide(F.col("gross_profit"), rev), "operating_margin": F.try_divide(F.col("operating_income"), rev), "net_margin": F.try_divide(F.col("net_income"), rev),
        "log_revenue": F.when(rev > 0, F.ln(rev)), "roa": F.try_divide(F.col("net_income"), F.col("assets")),
    })
    if calendar:
        past = panel.select(entity, (F.col(period) + lag).alias(period), F.col("revenue").alias("__r"), F.col("operating_income").alias("__o"))
        out = out.join(past, [entity, period], "left")
    else:
        w = W.partitionBy(entity).orderBy(period)
        out = out.withColumns({"__r": F.lag("revenue", lag).over(w), "__o": F.lag("operating_income", lag).over(w)})
    return out.withColumns({
        "revenue_growth": F.try_divide(rev, F.col("__r")) - 1, "operating_income_growth": F.try_divide(F.col("operating_income"), F.abs("__o")) - 1,
    }).drop("__r", "__o")
