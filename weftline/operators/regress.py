"""Two-way fixed effects with entity-clustered errors, from per-entity sums that add up across the cluster.

The model is y = post b + entity effects + period effects. Rows are first summed by entity and period; an entity's sums, with
its own mean taken out, give its share of the normal equations over (post, periods). For few periods that is a small matrix: tasks
add these up, Spark adds up the tasks, the driver gets one matrix an outcome, solves, and a second pass sums each entity's score for
the clustered errors. For many periods the equations are solved by conjugate gradients, a pass over the cells for each step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import workers

RESULT = "outcome string, nobs long, n_firms long, coef_post double, se_cluster double, t_stat double, p_value double, status string"


def normal_p(t: float) -> float:
    """Two-sided p-value of a normal statistic."""
    return math.erfc(abs(t) / math.sqrt(2)) if t == t else float("nan")


def cells(panel: DataFrame, outcomes: Sequence[str], entity: str, period: str, post: str) -> DataFrame:
    """outcome, entity, period and sums over the complete rows."""
    rows = panel.select(entity, period, F.col(post).cast("double").alias("p"), F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("y")) for o in outcomes])).alias("o"))
    rows = rows.select("o.outcome", F.col(entity).alias("entity"), F.col(period).alias("period"), "p", "o.y").na.drop()
    return rows.groupBy("outcome", "entity", "period").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum("y").alias("y"), F.sum(F.col("p") * F.col("y")).alias("py"))


def _dense(g: pd.DataFrame, place: dict) -> tuple[np.ndarray, ...]:
    """Of some whole entities: counts, sums of post and of the outcome by entity and period, and by entity the sums of post, its square and its product with the outcome."""
    _, who = np.unique(g["entity"].to_numpy(), return_inverse=True)
    at, shape = g["period"].map(place).to_numpy(), (int(who.max()) + 1, len(place))
    n, p, y = (np.zeros(shape) for _ in range(3))
    n[who, at], p[who, at], y[who, at] = g["n"], g["p"], g["y"]
    return n, p, y, np.bincount(who, g["pp"]), np.bincount(who, g["py"])


def _moments(g: pd.DataFrame, place: dict, beta: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y over (post, periods) with each entity's mean taken out, summed over some entities; with beta the sum of their scores' squares."""
    n, p, y, pp, py = _dense(g, place)
    size = n.sum(axis=1)
    s = np.column_stack([p.sum(axis=1), n])  # sums of the regressors
    ys = y.sum(axis=1)
    if beta is None:
        x = -(s / size[:, None]).T @ s
        x[0, 0] += pp.sum()
        x[0, 1:] += p.sum(axis=0)
        x[1:, 0] += p.sum(axis=0)
        x[np.arange(1, len(x)), np.arange(1, len(x))] += n.sum(axis=0)
        return x, np.concatenate([[py.sum()], y.sum(axis=0)]) - s.T @ (ys / size)
    fit = np.column_stack([pp * beta[0] + p @ beta[1:], p * beta[0] + n * beta[1:]]) - s * (s @ beta / size)[:, None]
    score = np.column_stack([py, y]) - s * (ys / size)[:, None] - fit
    return score.T @ score, np.zeros(len(beta))


def _sums(df: DataFrame, place: dict, solved: dict | None) -> dict:
    """outcome to (matrix, vector): each task adds up its entities', Spark adds up the tasks' entries, and the driver gets one matrix an outcome."""
    k = 1 + len(place)
    most = max(1, 2_000_000 // k)  # cells at a time, so that a task holds a few such tables

    def run(batches):
        total = {}
        for rows in _whole_entities(batches, most):
            for outcome, g in rows.groupby("outcome", sort=False):
                x, y = _moments(g, place, None if solved is None else solved[outcome])
                m, v = total.get(outcome, (0, 0))
                total[outcome] = (m + x, v + y)
        for outcome, (m, v) in total.items():
            i, j = np.nonzero(np.triu(m))
            at = np.flatnonzero(v)
            yield pd.DataFrame({"outcome": outcome, "i": np.concatenate([i, np.full(len(at), -1)]), "j": np.concatenate([j, at]), "v": np.concatenate([m[i, j], v[at]])})

    workers.ship(df.sparkSession)
    dealt = df.repartition("outcome", "entity").sortWithinPartitions("outcome", "entity")
    rows = dealt.mapInPandas(run, "outcome string, i long, j long, v double").groupBy("outcome", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for outcome, g in rows.groupby("outcome"):
        x, y = np.zeros((k, k)), np.zeros(k)
        pair, one = g[g["i"] >= 0], g[g["i"] < 0]
        x[pair["i"], pair["j"]] = pair["v"]
        x[pair["j"], pair["i"]] = pair["v"]
        y[one["j"]] = one["v"]
        out[outcome] = (x, y)
    return out


def _whole_entities(batches, most: int):
    """The rows of whole entities, about `most` at a time, from rows that are sorted by outcome and entity."""
    held = None
    for batch in batches:
        for first in range(0, len(batch), most):
            part = batch.iloc[first : first + most]
            held = part if held is None else pd.concat([held, part])
            same = (held["outcome"] == held["outcome"].iloc[-1]) & (held["entity"] == held["entity"].iloc[-1])
            if not same.all():
                yield held[~same]
                held = held[same]
    if held is not None and len(held):
        yield held


def _by_entity(g: pd.DataFrame, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's entity, and the entities' means of values (sums by cell, a column each)."""
    _, who = np.unique(g["entity"].to_numpy(), return_inverse=True)
    total = np.zeros((int(who.max()) + 1, values.shape[1]))
    np.add.at(total, who, values)
    return who, total / np.bincount(who, g["n"])[:, None]


def _demeaned(dealt: DataFrame, periods: int, vectors: dict[str, np.ndarray] | None) -> dict[str, np.ndarray]:
    """outcome to sums by period (a row) of what entity means leave: of post and outcome, or of period effects (vectors, two columns).

    Tasks add up their entities' sums, Spark adds up the tasks'; the driver gets vectors of one entry a period.
    """

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for rows in _whole_entities(batches, 500_000):
            for outcome, g in rows.groupby("outcome", sort=False):
                if vectors is not None and outcome not in vectors:
                    continue
                at, n = g["at"].to_numpy(), g["n"].to_numpy(np.float64)[:, None]
                sums = g[["p", "y"]].to_numpy(np.float64) if vectors is None else n * vectors[outcome][at]
                who, mean = _by_entity(g, sums)
                np.add.at(total.setdefault(outcome, np.zeros((periods, 2))), at, sums - n * mean[who])
        for outcome, v in total.items():
            at = np.flatnonzero(v.any(axis=1))
            yield pd.DataFrame({"outcome": outcome, "at": at, "p": v[at, 0], "y": v[at, 1]})

    rows = dealt.mapInPandas(run, "outcome string, at long, p double, y double").groupBy("outcome", "at").agg(F.sum("p").alias("p"), F.sum("y").alias("y")).toPandas()
    out = {}
    for outcome, g in rows.groupby("outcome"):
        out[outcome] = np.zeros((periods, 2))
        out[outcome][g["at"]] = g[["p", "y"]]
    return out


def _period_effects(dealt: DataFrame, periods: int, weight: dict[str, np.ndarray], exact: float = 1e-13) -> dict[str, np.ndarray]:
    """outcome to the period effects of post and of the outcome (two columns), by conjugate gradients on the normal equations.

    Entity effects are taken out where the rows are, so an iteration is one pass over the cells; all outcomes go together, and
    the equations are scaled by the periods' sizes. A column is done when its residual is `exact` of what it was.
    """
    residual = _demeaned(dealt, periods, None)
    scale = {o: 1 / np.sqrt(np.maximum(weight[o], 1))[:, None] for o in residual}
    x = {o: np.zeros((periods, 2)) for o in residual}
    r = {o: scale[o] * residual[o] for o in residual}
    way, size = dict(r), {o: (r[o] ** 2).sum(axis=0) for o in r}
    first, best = {o: size[o].copy() for o in r}, {o: (size[o].copy(), x[o].copy(), 0) for o in r}
    open_ = {o for o in r if size[o].any()}
    for k in range(4 * periods + 50):
        if not open_:
            break
        step = _demeaned(dealt, periods, {o: scale[o] * way[o] for o in open_})
        for o in list(open_):
            a = scale[o] * step.get(o, np.zeros((periods, 2)))
            along = (way[o] * a).sum(axis=0)
            by = np.divide(size[o], along, out=np.zeros(2), where=along > 0)
            x[o], r[o] = x[o] + by * way[o], r[o] - by * a
            new = (r[o] ** 2).sum(axis=0)
            way[o] = r[o] + np.divide(new, size[o], out=np.zeros(2), where=size[o] > 0) * way[o]
            size[o] = new
            if (new <= best[o][0]).all():
                best[o] = (new.copy(), x[o].copy(), k)
            if (new <= exact**2 * first[o]).all() or k - best[o][2] > 20:  # rounding lets it go no further
                open_.discard(o)
    return {o: scale[o] * best[o][1] for o in x}


def _scores(dealt: DataFrame, effects: dict[str, np.ndarray]) -> dict[str, dict]:
    """outcome to sums over entities, of what both sets of effects leave: post by outcome (a), post by itself (b), aa, ab, bb, and post's square (pp)."""

    def run(batches):
        for rows in _whole_entities(batches, 500_000):
            for outcome, g in rows.groupby("outcome", sort=False):
                n, sums = g["n"].to_numpy(np.float64)[:, None], g[["p", "y"]].to_numpy(np.float64)
                gamma = effects[outcome][g["at"].to_numpy()]
                who, mean = _by_entity(g, sums - n * gamma)
                fit = gamma + mean[who]
                (p, y), (fp, fy) = sums.T, fit.T
                b = np.bincount(who, g["pp"] - 2 * p * fp + n[:, 0] * fp * fp)
                a = np.bincount(who, g["py"] - p * fy - y * fp + n[:, 0] * fp * fy)
                yield pd.DataFrame({"outcome": [outcome], "a": a.sum(), "b": b.sum(), "aa": (a * a).sum(), "ab": (a * b).sum(), "bb": (b * b).sum(), "pp": g["pp"].sum()})

    names = ["a", "b", "aa", "ab", "bb", "pp"]
    got = dealt.mapInPandas(run, "outcome string, " + ", ".join(f"{n} double" for n in names)).groupBy("outcome").agg(*[F.sum(n).alias(n) for n in names])
    return {r["outcome"]: r.asDict() for r in got.collect()}


def _gradients(c: DataFrame) -> dict[str, tuple[float, float]]:
    """outcome to coefficient and uncorrected standard error, for any number of periods; what the effects explain in full is left out.

    Post and outcome are freed from entity and period effects; the coefficient and its clustered error then follow from sums of
    their products by entity.
    """
    workers.ship(c.sparkSession)
    size = c.groupBy("outcome", "period").agg(F.sum("n").alias("n")).toPandas()
    place = {p: k for k, p in enumerate(sorted(set(size["period"])))}
    weight = {o: np.bincount(g["period"].map(place), g["n"], len(place)) for o, g in size.groupby("outcome")}
    places = c.sparkSession.createDataFrame(pd.DataFrame({"period": list(place), "at": list(place.values())}), T.StructType([c.schema["period"], T.StructField("at", T.LongType())]))
    dealt = c.join(places, "period").select("outcome", "entity", "at", "n", "p", "pp", "y", "py").repartition("outcome", "entity").sortWithinPartitions("outcome", "entity").persist()
    try:
        sums = _scores(dealt, _period_effects(dealt, len(place), weight))
    finally:
        dealt.unpersist()
    out = {}
    for o, v in sums.items():
        if v["b"] > 1e-11 * v["pp"]:
            beta = v["a"] / v["b"]
            out[o] = (beta, math.sqrt(max(v["aa"] - 2 * beta * v["ab"] + beta * beta * v["bb"], 0.0)) / v["b"])
    return out


def _dense_solution(c: DataFrame, periods: Sequence) -> dict[str, tuple[float, float]]:
    """The same by one matrix an outcome over (post, periods), for few periods: two passes over the cells."""
    place = {p: k for k, p in enumerate(sorted(periods))}
    gram = _sums(c, place, None)
    inverse = {o: np.linalg.pinv(x) for o, (x, _) in gram.items()}
    beta = {o: inverse[o] @ y for o, (_, y) in gram.items()}
    out = {}
    for o, (meat, _) in _sums(c, place, beta).items():
        out[o] = (float(beta[o][0]), math.sqrt(max((inverse[o] @ meat @ inverse[o])[0, 0], 0.0)))
    return out


#: Periods up to which the normal equations are solved as a matrix on the driver.
MOST_DENSE = 200


def twfe(panel: DataFrame, outcomes: Sequence[str], entity: str, period: str, post: str, most_dense: int = MOST_DENSE) -> DataFrame:
    """One result row an outcome; `not_enough_variation` with fewer than two values of post or three entities.

    Up to most_dense periods the period effects are solved for on the driver, beyond it by conjugate gradients over passes of the
    cluster; results agree, and the driver never holds more than vectors of one entry a period then. A post that the effects
    explain in full gives no numbers.
    """
    spark = panel.sparkSession
    c = cells(panel, outcomes, entity, period, post).persist()  # one row for each outcome, entity and period
    try:
        return _solved(spark, c, outcomes, most_dense)
    finally:
        c.unpersist()


def _solved(spark, c: DataFrame, outcomes: Sequence[str], most_dense: int) -> DataFrame:
    mean = F.col("p") / F.col("n")
    about = c.groupBy("outcome").agg(F.sum("n").alias("n"), F.count_distinct("entity").alias("firms"), F.count_distinct("period").alias("periods"), F.min(mean).alias("least"), F.max(mean).alias("most"))
    about = {r["outcome"]: r for r in about.collect()}
    periods = [r["period"] for r in c.select("period").distinct().limit(most_dense + 1).collect()]
    solution = _gradients(c) if len(periods) > most_dense else _dense_solution(c, periods)
    out = []
    for o in outcomes:
        r = about.get(o)
        if r is None or r["firms"] < 3 or r["least"] == r["most"]:
            out.append((o, r["n"] if r else 0, r["firms"] if r else 0, None, None, None, None, "not_enough_variation"))
            continue
        n, firms = r["n"], r["firms"]
        b, se = solution.get(o, (None, None))
        k = 1 + 1 + (firms - 1) + (r["periods"] - 1)  # constant, post, entities, periods
        if b is not None and n > k:
            se *= math.sqrt((firms / (firms - 1)) * ((n - 1) / (n - k)))
        t = None if b is None else b / se if se else float("nan")
        out.append((o, n, firms, b, se, t, None if t is None else normal_p(t), "ok"))
    return spark.createDataFrame(out, RESULT)
