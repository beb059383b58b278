"""Language identification: averaged hashed subword embeddings under a linear softmax.

Training runs in numpy on the driver, by stochastic gradient descent over pieces of a bounded sample. A text's embedding
is the mean of the embeddings of its byte 3-grams and 4-grams (cased letters folded, all but letters a blank), so that
embedding times softmax weights is one table of class scores by n-gram: scoring sums table rows over the whole text.
A temperature fitted on held-back pieces calibrates the scores, and answers under a calibrated threshold are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BITS, DIM, ORDERS = 16, 16, (3, 4)
#: The bounds of the sample: documents a language, bytes of a document that may be in it, and pieces of all of them together.
MAX_DOCS, MAX_BYTES, MAX_PIECES = 1000, 32768, 12000
MULT = {3: np.uint32(2654435761), 4: np.uint32(2246822519)}

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def grams(raw: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte; the last bucket, which scores 0, where a text has no n bytes left."""
    c = _FOLD[raw].astype(np.uint32)
    out = np.full(len(raw), 1 << BITS, np.int32)
    if len(raw) >= n:
        v = c[: len(c) - n + 1].copy()
        for k in range(1, n):
            v |= c[k : len(c) - n + 1 + k] << np.uint32(8 * k)
        out[: len(v)] = (v * MULT[n]) >> np.uint32(32 - BITS)
    for k in range(1, n):
        out[starts[1:][starts[1:] >= k] - k] = 1 << BITS
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (classes, buckets + 1): class scores of each n-gram
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    extra: dict = field(default_factory=dict)

    def logits(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        total = np.zeros((len(self.langs), len(starts) - 1))
        n = np.zeros(len(starts) - 1)
        length = np.diff(starts)
        for order in ORDERS:
            n += np.maximum(0, length - order + 1)
            if len(starts) == 2 and len(raw) > common.PIECE:  # one very long text, in pieces that overlap by what an n-gram needs
                cuts = [(raw[k : k + common.PIECE + order - 1], np.array([0, len(raw[k : k + common.PIECE + order - 1])])) for k in range(0, len(raw), common.PIECE)]
            else:
                cuts = [(raw, starts)]
            for part, edges in cuts:
                at = grams(part, edges, order)
                for c in range(len(self.langs)):
                    total[c] += common.sums(self.table[c][at], edges)
        return (total / np.maximum(n, 1)).T + self.bias

    def probabilities(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return softmax(self.logits(raw, starts) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def pieces(texts: list[str], labels: np.ndarray, rng: np.random.Generator, most: int = MAX_PIECES) -> tuple[list[bytes], np.ndarray]:
    """Pieces of 12 to 240 bytes at places drawn over the whole of each text, as many from each: about `most` in all, 1 to 8 a text."""
    each = max(1, min(8, most // max(1, len(texts))))
    out, who = [], []
    for text, y in zip(texts, labels, strict=True):
        b = text.encode()
        for _ in range(each if len(b) > 240 else 1):
            size = int(rng.integers(12, 240))
            at = int(rng.integers(0, max(1, len(b) - size)))
            out.append(b[at : at + size])
            who.append(y)
    return out, np.array(who)


def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


def fit(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 1.5, batch: int = 64, seed: int = 7, target: float = 0.99, max_pieces: int = MAX_PIECES) -> Model | None:
    """A model of the labelled texts, learned from about max_pieces pieces of them; None where there is none."""
    if not texts:
        return None
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    x, y = pieces(texts, np.array([names.index(v) for v in langs]), rng, max_pieces)
    order = rng.permutation(len(x))
    back = order[: max(1, len(x) // 10)] if len(x) >= 20 else order
    train = order[len(x) // 10 :] if len(x) >= 20 else order
    emb = rng.uniform(-1 / DIM, 1 / DIM, ((1 << BITS) + 1, DIM)).astype(np.float32)
    emb[-1] = 0
    w, b = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, step = epochs * -(-len(train) // batch), 0
    for _ in range(epochs):
        rng.shuffle(train)
        for k in range(0, len(train), batch):
            ids = train[k : k + batch]
            raw, starts = packed([x[i] for i in ids])
            at = np.concatenate([grams(raw, starts, n) for n in ORDERS])
            who = np.tile(np.repeat(np.arange(len(ids)), np.diff(starts)), len(ORDERS))
            live = at < 1 << BITS
            at, who = at[live], who[live]
            n = np.maximum(1, np.bincount(who, minlength=len(ids)))[:, None]
            mean = np.zeros((len(ids), DIM), np.float32)
            np.add.at(mean, who, emb[at])
            mean /= n
            g = softmax(mean @ w + b)
            g[np.arange(len(ids)), y[ids]] -= 1
            lr = rate * (1 - step / steps)
            back_h = ((g @ w.T) / n).astype(np.float32)
            w -= lr * (mean.T @ g).astype(np.float32) / len(ids) * 8
            b -= lr * g.mean(axis=0)
            np.add.at(emb, at, -lr * back_h[who])
            step += 1
    model = Model(names, np.ascontiguousarray((emb @ w).T.astype(np.float32)), b.astype(np.float64))
    model.table[:, -1] = 0
    raw, starts = packed([x[i] for i in back])
    logits, truth = model.logits(raw, starts), y[back]
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.05, 8, 60), key=loss))
    p = softmax(logits / model.temperature)
    sure, right = p.max(axis=1), p.argmax(axis=1) == truth
    by = np.argsort(-sure)
    precise = np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= target
    model.threshold = float(sure[by][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, max_pieces: int = MAX_PIECES) -> Model | None:
    """Learns from text and non-null lang of documents that are not held out: at most about max_docs a language, of at most max_bytes, and of
    their texts about max_pieces short pieces (at least one and at most eight a text) at places drawn over the whole text."""
    ok = F.col(id_col).isNotNull() & ~common.held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    rows = docs.filter(ok).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    got = common.bounded_sample(rows, "id", max_docs, "lang").filter(F.octet_length("text") <= max_bytes).collect()
    got.sort(key=lambda r: (str(r["id"]), r["lang"], r["text"]))
    return fit([r["text"] for r in got], [r["lang"] for r in got], max_pieces=max_pieces)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, held_out, lang_pred, score, accepted.

    lang_pred is the likeliest learned language of the whole text, score its calibrated probability; `und` with score 0
    where the text is null, has no letter, or nothing was learned. accepted is false for these and under the model's
    threshold. A text with letters but no n-gram goes by the bias. Null and repeated ids and ties of score (the first
    language by name) need no care; empty docs give no rows; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def run(batches):
        m = held.value
        for batch in batches:
            texts = common.binary_texts(batch, "__text")
            lang = np.full(len(texts), "und", object)
            score, accepted = np.zeros(len(texts)), np.zeros(len(texts), bool)
            for first, end, raw, starts in common.byte_blocks(texts) if m else ():
                p = m.probabilities(raw, starts)
                letters = common.sums(_ASCII_LETTER[raw], starts) > 0
                wide = common.sums(raw >= 128, starts) > 0
                for k in np.flatnonzero(wide & ~letters):
                    letters[k] = any(c.isalpha() for c in raw[starts[k] : starts[k + 1]].tobytes().decode())
                best = p.argmax(axis=1)
                lang[first:end] = np.where(letters, np.array(m.langs, object)[best], "und")
                score[first:end] = np.where(letters, p[np.arange(len(p)), best], 0)
                accepted[first:end] = letters & (p.max(axis=1) >= m.threshold)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)], [id_col, "held_out", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col(id_col).alias("__id"), common.held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("__text"))
    return common.arrow_map(rows, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.spread(common.table(spark, sf_dir, "documents"))
    return identify(docs, train(docs))


SQL = None
