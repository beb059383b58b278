"""Quality classifier: logistic regression over hashed word n-grams, learned by follow-the-regularised-leader updates.

Words are runs of letters, digits or other signs. The features of a text are its words, its word pairs, the pairs of its
words' shapes, and the pattern of equal words among three in a row (an n-gram of places instead of words, which stands for
repetition whatever the word). All are hashed into one weight vector; a text's score is the sparse dot product of its
feature shares with it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BITS, SCALE = 18, 30.0
#: The bounds of the sample that labels are learned from: documents, and bytes of one.
MAX_DOCS, MAX_BYTES = 6000, 32768
CUT = 0.3

_CLASS = np.full(256, 3, np.uint8)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_R = np.uint64(0x100000001B3)
_R_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, n of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_R, _R_INVERSE)):
            x = np.full(max(n, (1 << 18) + 1024), base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def buckets(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    return ((h * _K[0]) >> np.uint64(64 - BITS)).astype(np.int32)


def _begins(raw: np.ndarray) -> np.ndarray:
    """Where words begin in a stretch of a text: other than blanks, of another kind than the byte before."""
    kind = _CLASS[raw]
    out = kind != 0
    out[1:] &= kind[1:] != kind[:-1]
    return out


def features(raw: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Four arrays of buckets, one entry a word each, and where each text's words start (and the end)."""
    if not len(raw):
        return [np.zeros(0, np.int32)] * 4, np.zeros(len(starts), np.int64)
    kind = _CLASS[raw]
    change = np.ones(len(raw), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[starts[:-1][starts[:-1] < len(raw)]] = True
    begin = np.flatnonzero(change)
    stop = np.append(begin[1:], len(raw))
    word = kind[begin] != 0
    begin, stop = begin[word], stop[word]
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = (total[stop] - total[begin]) * down[begin]
    size = stop - begin
    uppers = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    big = uppers[stop] - uppers[begin]
    k = kind[begin]
    shape = np.where(k == 1, np.where(big == 0, 0, np.where((big == size) & (size > 1), 2, np.where((big == 1) & (_UPPER[raw[begin]] == 1), 1, 3))), np.where(k == 2, 4, 4 + np.minimum(size, 3)))
    texts = np.searchsorted(begin, starts)
    first = np.zeros(len(begin) + 1, bool)
    first[texts] = True
    first = first[:-1]
    second = np.zeros(len(begin), bool)
    second[1:] = first[:-1]
    second |= first
    last = np.roll(h, 1)
    last[first] = _K[1]
    before = np.roll(h, 2)
    before[second] = _K[2]
    shape = shape.astype(np.uint64)
    last_shape = np.roll(shape, 1)
    last_shape[first] = 15
    pair = last * _K[3] + h
    shapes = (last_shape * np.uint64(16) + shape + np.uint64(1)) * _K[1]
    same = ((h == last).astype(np.uint64) * np.uint64(2) + (h == before)) * np.uint64(16) + shape
    return [buckets(h), buckets(pair), buckets(shapes), buckets((same + np.uint64(7)) * _K[2])], texts


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if len(starts) == 2 and len(raw) > common.PIECE:  # one very long text
            dot, n = np.zeros(1), np.zeros(1)
            for first, end, skip in common.word_pieces(raw, _begins, 2):
                parts, _ = features(raw[first:end], np.array([0, end - first]))
                dot += sum(self.weights[x[skip:]].sum(dtype=np.float64) for x in parts)
                n += len(parts[0]) - skip
        else:
            parts, at = features(raw, starts)
            dot, n = sum(common.sums(self.weights[x], at) for x in parts), np.diff(at)
        z = self.bias + SCALE * dot / np.maximum(1, n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str], labels: list[int], epochs: int = 3, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0, seed: int = 5) -> Model:
    """Follow-the-regularised-leader with a rate for each weight; without texts every score is a half."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = bias = 0.0
    rows = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        parts, at = features(raw, np.array([0, len(raw)]))
        ids, counts = np.unique(np.concatenate(parts), return_counts=True)
        rows.append((ids, (SCALE / max(1, int(at[-1]))) * counts))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, x = rows[i]
            w = weights(z[ids], n[ids])
            bias = -zb / ((beta + nb**0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w @ x + bias, -30, 30)))
            g = (p - labels[i]) * x
            s = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha
            z[ids] += g - s * w
            n[ids] += g * g
            gb = p - labels[i]
            zb += gb - ((nb + gb * gb) ** 0.5 - nb**0.5) / alpha * bias
            nb += gb * gb
    return Model(weights(z, n).astype(np.float32), float(-zb / ((beta + nb**0.5) / alpha)))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, max_docs: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text", stratified: bool = False) -> tuple[DataFrame, dict]:
    """id, y and text of at most about max_docs labelled documents (a label, if stratified) that are not held out, and the labels' counts.

    Of rows that repeat an id the least text counts, so the rows are bounded by the ids.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~common.held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
    chosen = common.bounded_sample(known, "id", max_docs, "y" if stratified else None)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    rows = rows.join(F.broadcast(chosen.distinct()), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # chosen has a bounded number of ids
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()} if stratified else {}
    return rows, counts


def sampled(rows: DataFrame) -> tuple[list[str], list[int]]:
    """Texts and labels of labelled_rows(), in an order of their own."""
    got = sorted(rows.collect(), key=lambda r: (str(r["id"]), r["y"], r["text"]))
    return [r["text"] for r in got], [r["y"] for r in got]


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Model:
    return fit(*sampled(labelled_rows(docs, labels, "quality", max_docs, max_bytes)[0]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = ()) -> DataFrame:
    """A row for each row of docs: id, held_out, score, predicted (score >= CUT), and the columns in carry.

    Null and empty texts have no features and get the bias' score. Repeated rows and ids get equal scores, null ids stay
    null, empty docs give no rows; without labels every score is a half. Columns not named are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    who, fold, text = (common.unused(docs, c) for c in ("__id", "__held", "__text"))
    made = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*made, *[T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(carry)]])

    def run(batches):
        m = held.value
        for batch in batches:
            texts = common.binary_texts(batch, text)
            out = np.zeros(len(texts))
            for first, end, raw, starts in common.byte_blocks(texts):
                out[first:end] = m.scores(raw, starts)
            yield pa.RecordBatch.from_arrays([batch.column(who), batch.column(fold), pa.array(out), *[batch.column(c) for c in carry]], schema.names)

    rows = docs.select(F.col(id_col).alias(who), common.held_out(F.col(id_col)).alias(fold), F.col(text_col).alias(text), *[F.col(f"`{c}`") for c in carry])
    scored = common.arrow_map(rows, run, schema).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
    return scored.select(id_col, "held_out", "score", "predicted", *[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)])


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model rejects; all columns stay, whatever their names."""
    x = score(docs, model, carry=docs.columns)
    names = x.columns[4:]
    x = x.toDF("i", "h", "s", "p", *[f"c{k}" for k in range(len(names))])
    return x.filter("p = 1").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.spread(common.table(spark, sf_dir, "documents"))
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))


SQL = None
