"""Evidence-weighted classification: phrase counts over a taxonomy, guardrails, ranking, confidence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import workers
from ..functions.automaton import Automaton, blocks


@dataclass(frozen=True)
class Term:
    broad: str
    sub: str
    term: str


@dataclass(frozen=True)
class Guardrail:
    phrases: tuple[str, ...]
    broad: str
    sub: str
    delta: int
    min_hits: int = 1


def extend(terms: Sequence[Term], more: Sequence[Term]) -> list[Term]:
    """terms and those of more that they lack, in order."""
    return list(dict.fromkeys([*terms, *more]))


def bonus(term: str) -> int:
    """3 for a term with a blank, else 1 (also for hyphens)."""
    return 3 if " " in term else 1


def _times(words: str, word: str) -> Column:
    return F.size(F.filter(words, lambda x: x == word)).cast("long")


def _every(sources: dict[str, int], cap: int | None) -> Column:
    """The text that guardrails look at: all sources in a row, of which the first cap characters, or all if cap is None."""
    c = X.clean(F.concat_ws(" ", *[F.col(s) for s in sources]))
    return F.lower(c if cap is None else F.left(c, F.lit(cap)))


def entries(docs: DataFrame, sources: dict[str, int], terms: Sequence[Term], guardrails: Sequence[Guardrail] = (), cap: int | None = 10000, out: str = "entries") -> DataFrame:
    """docs with an array of (ordinal, broad, sub, score) for the entries that a term or a guardrail touches.

    sources gives each text column's weight. The rules are a short list, made into one expression, so a document is scored
    in its own row: no documents-by-terms join and no shuffle. Terms of letters and digits are counted among the text's words, of
    which only those that are terms are looked at again; other terms are searched for in the text. Terms count in whole texts,
    guardrails in the first cap characters of all sources (as the reference has it) or, with None, in whole ones too.
    """
    places = list(dict.fromkeys([(t.broad, t.sub) for t in terms] + [(g.broad, g.sub) for g in guardrails]))
    words = sorted({w for t in terms if (w := t.term.lower().strip()).isascii() and w.isalnum()})
    low = {f"__t{i}": F.lower(X.clean(F.col(c))) for i, c in enumerate(sources)}
    every = _every(sources, cap)
    base = docs.withColumns(low | {"__all": every})
    if words:
        base = base.withColumns({f"__w{i}": F.filter(F.split(F.col(f"__t{i}"), "[^a-z0-9]+"), lambda w: w.isin(words)) for i in range(len(sources))})
    found = []
    for place, (broad, sub) in enumerate(places):
        hits = F.lit(0).cast("long")
        for t in terms:
            if (t.broad, t.sub) == (broad, sub):
                w = t.term.lower().strip()
                for i, weight in enumerate(sources.values()):
                    n = _times(f"__w{i}", w) if w in words else X.phrase_count(F.col(f"__t{i}"), t.term)
                    hits = hits + n * (weight * bonus(t.term))
        touched, extra = hits > 0, F.lit(0).cast("long")
        for g in guardrails:
            if (g.broad, g.sub) == (broad, sub):
                n = sum((F.contains("__all", F.lit(p)).cast("int") for p in g.phrases), F.lit(0))
                fires = n >= g.min_hits
                extra = extra + F.when(fires, g.delta).otherwise(0)
                touched = touched | fires
        found.append(F.when(touched, F.struct(F.lit(place).alias("ordinal"), F.lit(broad).alias("broad"), F.lit(sub).alias("sub"), (hits + extra).alias("score"))))
    return base.withColumn(out, F.array_compact(F.array(*found))).drop("__all", *low, *[f"__w{i}" for i in range(len(sources))])


#: Rows of a table of terms or rules at most: such a table goes to the driver and is broadcast as an automaton.
MOST_RULES = 200_000


def _bounded(table: DataFrame, order: str) -> list:
    rows = table.orderBy(order).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    return rows


def read_terms(table: DataFrame) -> list[Term]:
    """The terms of a table (ordinal, broad, sub, term), in order, repeated and blank ones once and not at all."""
    return extend([Term(r["broad"], r["sub"], r["term"]) for r in _bounded(table, "ordinal") if (r["term"] or "").strip()], [])


def read_rules(table: DataFrame) -> list[Guardrail]:
    """The guardrails of a table (ordinal, phrases, broad, sub, delta, min_hits), in order."""
    return [Guardrail(tuple(r["phrases"]), r["broad"], r["sub"], r["delta"], r["min_hits"]) for r in _bounded(table, "ordinal")]


def scanned(docs: DataFrame, sources: dict[str, int], terms: Sequence[Term], guardrails: Sequence[Guardrail] = (), cap: int | None = 10000, out: str = "entries") -> DataFrame:
    """entries() for any number of terms: each text is read once, by an automaton of all phrases, and the time doesn't grow with them.

    The same entries in the same order. The automata are broadcast; their size is bounded. Texts go to Python in Arrow batches.
    """
    workers.ship(docs.sparkSession)
    places = list(dict.fromkeys([(t.broad, t.sub) for t in terms] + [(g.broad, g.sub) for g in guardrails]))
    at = {p: k for k, p in enumerate(places)}
    phrase = lambda t: t.term.lower().strip()
    points: dict[str, dict[int, int]] = {}
    for t in terms:
        if p := phrase(t):
            to = points.setdefault(p, {})
            to[at[t.broad, t.sub]] = to.get(at[t.broad, t.sub], 0) + bonus(t.term)
    signs = list(dict.fromkeys(p for g in guardrails for p in g.phrases if p))
    # of rules, which phrases each has; a phrase that a rule names twice counts twice, an empty one always
    rules = [(at[g.broad, g.sub], g.delta, g.min_hits - sum(not p for p in g.phrases), [signs.index(p) for p in g.phrases if p]) for g in guardrails]
    held = docs.sparkSession.sparkContext.broadcast((Automaton(list(points)), Automaton(signs, words=False), list(points.values()), rules, places))
    low = {f"__t{i}": F.lower(X.clean(F.col(c))) for i, c in enumerate(sources)}
    every = _every(sources, cap)
    weights, kept = list(sources.values()), docs.columns
    entry = "array<struct<ordinal:int,broad:string,sub:string,score:long>>"
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T._parse_datatype_string(entry))])

    def scores_of(columns: list[list[str]], everything: list[str]):
        words, marks, points_of, rules, places = held.value
        score = np.zeros((len(everything), len(places)), np.int64)
        touched = np.zeros(score.shape, bool)
        for weight, texts in zip(weights, columns, strict=True):
            text, found, n = words.counts(texts)
            for row, p, times in zip(text.tolist(), found.tolist(), n.tolist(), strict=True):
                for place, more in points_of[p].items():
                    score[row, place] += times * weight * more
        touched |= score > 0
        if rules:
            has = np.zeros((len(everything), len(marks.size) + 1), bool)
            row, sign, _ = marks.counts(everything)
            has[row, sign] = True
            for place, delta, least, which in rules:
                fires = has[:, which].sum(axis=1) >= least
                score[fires, place] += delta
                touched |= fires[:, None] & (np.arange(len(places)) == place)
        return score, touched

    def run(batches):
        places = held.value[4]
        for batch in batches:
            texts = [batch.column(f"__t{i}") for i in range(len(weights))] + [batch.column("__every")]
            sizes = sum((np.asarray(pc.fill_null(pc.utf8_length(t), 0)).astype(np.int64) for t in texts), np.zeros(len(batch), np.int64))
            parts = []
            for a, b in blocks(sizes.tolist()):
                *columns, everything = ([x or "" for x in t.slice(a, b - a).to_pylist()] for t in texts)
                score, touched = scores_of(columns, everything)
                row, place = np.nonzero(touched)
                parts.append((np.bincount(row, minlength=b - a), place, score[row, place]))
            size, place, score = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
            names = [pa.array([places[k][j] for k in place.tolist()], pa.string()) for j in (0, 1)]
            fields = pa.StructArray.from_arrays([pa.array(place, pa.int32()), *names, pa.array(score, pa.int64())], ["ordinal", "broad", "sub", "score"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), fields)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lists], schema.names)

    return docs.withColumns(low | {"__every": every}).mapInArrow(run, schema)


def scores(docs: DataFrame, key: str, sources: dict[str, int], terms: Sequence[Term], guardrails: Sequence[Guardrail] = (), cap: int | None = 10000) -> DataFrame:
    """key, ordinal, broad, sub, score: entries() as rows."""
    # of explode() Spark infers a filter on the array, which is put under the projection: all entries would be worked out twice
    return entries(docs, sources, terms, guardrails, cap, "__e").select(key, F.explode_outer("__e").alias("e")).filter("e is not null").select(key, "e.*")


def confidence(top: Column, margin: Column, second: Column, other_broad: Column, fetched: Column, structured: Column, snippet_only: Column) -> Column:
    """The ladder from scores to low, medium and high."""
    base = (
        F.when(snippet_only, F.when((top >= 18) & (margin >= 5), "medium").otherwise("low"))
        .when(fetched & structured & (top >= 35) & (margin >= 8), "high")
        .when(fetched & (top >= 16) & (margin >= 4), "medium").otherwise("low")
    )
    return F.when((second > 0) & other_broad & (margin < 6), "low").otherwise(base)


def classify(scored: DataFrame, key: str, fetched: Column, structured: Column, snippet_only: Column, found: str = "entries") -> DataFrame:
    """key, broad, sub, score, margin, confidence, review from the entries of each row. Ties keep the taxonomy's order; no positive score is unclassified."""
    best = F.array_sort(F.transform(found, lambda e: F.struct((-e["score"]).alias("neg"), e["ordinal"].alias("ordinal"), e["broad"].alias("broad"), e["sub"].alias("sub"), e["score"].alias("score"))))
    out = scored.select(key, F.slice(best, 1, 2).alias("r"), fetched.alias("__f"), structured.alias("__s"), snippet_only.alias("__o"))
    first, second = F.try_element_at("r", F.lit(1)), F.try_element_at("r", F.lit(2))
    top, next_ = F.coalesce(first["score"], F.lit(0)), F.coalesce(second["score"], F.lit(0))
    ok = top > 0
    level = confidence(top, top - next_, next_, first["broad"] != F.coalesce(second["broad"], F.lit("None")), F.col("__f"), F.col("__s"), F.col("__o"))
    out = out.select(
        key, F.when(ok, first["broad"]).otherwise("Other / Unclassified").alias("broad"), F.when(ok, first["sub"]).otherwise("Needs manual review").alias("sub"),
        top.alias("score"), (top - next_).alias("margin"), F.when(ok, level).otherwise("low").alias("confidence"),
    )
    return out.withColumn("review", (F.col("confidence") == "low") | (F.col("broad") == "Other / Unclassified"))
