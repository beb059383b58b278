"""Removal of repeated passages of N bytes, by the collection transform of the places where texts may agree.

A text is cut where its content says so: of each window of N bytes the least hashed K-gram is the anchor, so equal windows
have equal anchors, whatever stands around them. A screen drops the anchors that only one document has. The windows in a row
with one anchor make a segment, a short string; equal segments are counted once with their smallest document. Segments
are dealt out by anchor, and each task builds the Burrows-Wheeler transform and common prefixes of its segments, a column
at a time: suffixes in a row with a common prefix of N bytes are equal windows, and the smallest document of the row is the
one that keeps them. A symbol is WIDTH bytes and a segment one string for each offset below that, which takes a fifth of the
rounds. The answers go back to the places by segment, and then to the texts.

An anchor with over HOT different segments is not sorted in one task: its windows are grouped one by one instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bwt, common, quality, screen
from .jaccard_join import finish

N, K = 50, 20
SCREEN_BITS, BATCH, HOT = 27, 2048, 4096
#: Documents in a few MB of anchors from which an anchor is dealt out in parts, as hot.
OFTEN = 200
#: Bytes of a symbol of the transform: N is a multiple, so that a window is N / WIDTH symbols.
WIDTH = 5
_PLACE, _MIX = np.uint64((1 << 24) - 1), np.uint64(0x9E3779B97F4A7C15)
#: Texts are read in pieces of at most this many bytes, which overlap by N - 1.
PIECE = 8 << 20


def segments(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment of a block of texts: anchor hash, text, first window's start, and end of the last window."""
    long = np.flatnonzero(np.diff(starts) >= N)
    if not len(long):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    up, down = quality.powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = (total[K:] - total[:-K]) * down[: len(raw) - K + 1] * _MIX
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, want = 1, N - K + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(raw) - N + 1], least[want - width : want - width + len(raw) - N + 1])
    # a segment begins at a text's first window and where the least K-gram is another
    first = np.union1d(np.flatnonzero(least[1:] != least[:-1]) + 1, starts[long])
    text = np.searchsorted(starts, first, "right") - 1
    last = starts[text + 1] - N
    text, first, last, after = text[first <= last], first[first <= last], last[first <= last], np.append(first[1:], len(raw))[first <= last]
    return h[(least[first] & _PLACE).astype(np.int64)], text, first, np.minimum(last, after - 1) + N


def pieces(raw: np.ndarray, starts: np.ndarray):
    """A block of texts, or a very long text in pieces: first row, offset in its text, bytes, starts."""
    if len(raw) <= PIECE:
        yield 0, raw, starts
        return
    for k in range(0, len(raw) - N + 1, PIECE - N + 1):
        part = raw[k : k + PIECE]
        yield k, part, np.array([0, len(part)])


def anchor_hashes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The anchors of each text, once."""
    out = []
    for _, part, edges in pieces(raw, starts):
        h, text, _, _ = segments(part, edges)
        _, one = np.unique(finish(h + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)
        out.append(h[one])
    return np.concatenate(out)


def _found(docs: DataFrame, twice, hot) -> DataFrame:
    """Segments (h, salt, bytes) of docs (id, text) that may be shared, with the least and the largest document, once a task and few MB."""
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("salt", T.IntegerType()), T.StructField("bytes", T.BinaryType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])

    def run(batches):
        seen: dict[bytes, int] = {}
        hs, lo, hi = [], [], []

        def out():
            h = np.array(hs, np.uint64)
            salt = np.full(len(h), -1, np.int32)
            often, strings = np.flatnonzero(hot.value.has(h)), list(seen)
            salt[often] = [xxhash.xxh32_intdigest(strings[k]) & 63 for k in often]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(salt), pa.array(strings, pa.binary()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], schema.names)

        for batch in batches:
            ids = batch.column("id").to_numpy()
            for first, _, raw, starts in common.byte_blocks(common.binary_texts(batch, "text")):
                for _, part, edges in pieces(raw, starts):
                    h, text, a, b = segments(part, edges)
                    keep = twice.value.has(h)
                    data = part.tobytes()
                    for anchor, who, x, y in zip(h[keep].tolist(), ids[first + text[keep]].tolist(), a[keep].tolist(), b[keep].tolist(), strict=True):
                        s = data[x:y]
                        k = seen.get(s)
                        if k is None:
                            seen[s] = len(hs)
                            hs.append(anchor)
                            lo.append(who)
                            hi.append(who)
                        elif who < lo[k]:
                            lo[k] = who
                        elif who > hi[k]:
                            hi[k] = who
                    if len(hs) > 100_000:
                        yield out()
                        seen.clear()
                        hs, lo, hi = [], [], []
        if hs:
            yield out()

    return common.arrow_map(docs, run, schema)


def _places(docs: DataFrame, twice, answered) -> DataFrame:
    """Where (id, t, start) the segments (gid) stand that answered lets through, of docs (id, text, t)."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.LongType()), T.StructField("start", T.LongType()), T.StructField("gid", T.BinaryType())])

    def run(batches):
        for batch in batches:
            ids, ts = batch.column("id").to_numpy(), batch.column("t").to_numpy()
            for first, _, raw, starts in common.byte_blocks(common.binary_texts(batch, "text")):
                for offset, part, edges in pieces(raw, starts):
                    h, text, a, b = segments(part, edges)
                    keep = twice.value.has(h)
                    text, a, b = text[keep], a[keep], b[keep]
                    data = part.tobytes()
                    gids = [xxhash.xxh3_128_digest(data[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    keep = np.flatnonzero(answered.value.has(np.frombuffer(b"".join(gids), "<u8")[::2]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[first + text[keep]]), pa.array(ts[first + text[keep]]), pa.array((a - edges[text])[keep] + offset), pa.array([gids[k] for k in keep], pa.binary())], schema.names)

    return common.arrow_map(docs, run, schema)


_ANSWER = T.StructType([
    T.StructField("gid", T.BinaryType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("first", T.LongType()),
    T.StructField("bytes", T.BinaryType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()),
])


def _answers(strings: list[bytes], lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Runs of windows (a to b, by their start in the segment) that a smaller document than one of the segment's has."""
    symbols, edges, who, phase = bwt.grams(strings, WIDTH, N // WIDTH)
    _, owner, length, lcp = bwt.transform(symbols, edges, N // WIDTH)
    size = np.diff(edges)
    starts = np.flatnonzero(lcp < N // WIDTH)
    smallest = np.repeat(np.minimum.reduceat(lo[who[owner]], starts), np.diff(np.append(starts, len(owner))))
    live = (length >= N // WIDTH) & (smallest < hi[who[owner]])
    at = ((size[owner] - length) * WIDTH + phase[owner])[live]
    who, best = who[owner[live]], smallest[live]
    order = np.lexsort((at, who))
    who, at, best = who[order], at[order], best[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (best[1:] != best[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(who))[: len(first)] - 1
    none = len(first)
    return pa.RecordBatch.from_arrays([
        pa.array([xxhash.xxh3_128_digest(strings[k]) for k in who[first]], pa.binary()), pa.array(at[first], pa.int32()), pa.array(at[last], pa.int32()), pa.array(best[first], pa.int64()),
        pa.nulls(none, pa.binary()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64())], _ANSWER.names)


def _copies(strings: list[bytes], lo: np.ndarray) -> pa.RecordBatch:
    """Answers of segments that only equal ones share an anchor with: all windows are the smallest document's."""
    n = len(strings)
    return pa.RecordBatch.from_arrays([
        pa.array([xxhash.xxh3_128_digest(s) for s in strings], pa.binary()), pa.array(np.zeros(n, np.int32)), pa.array([len(s) - N for s in strings], pa.int32()), pa.array(lo),
        pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], _ANSWER.names)


def _hot(strings: list[bytes], lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    n = len(strings)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(strings, pa.binary()), pa.array(lo), pa.array(hi)], _ANSWER.names)


def _whole(batches):
    """Tables of whole anchors from the sorted batches of a task, and whether they are one anchor with over HOT segments, which comes in parts."""
    held, size, crowded = [], 0, None
    for batch in batches:
        if not len(batch):
            continue
        h = batch.column("h").to_numpy()
        first, cut = int(np.searchsorted(h, h[0], "right")), int(np.searchsorted(h, h[-1], "left"))
        if crowded is not None and h[0] == crowded:
            yield pa.Table.from_batches([batch.slice(0, first)]), True
            batch = batch.slice(first)
            cut -= first
            if not len(batch):
                continue
        crowded = None
        if cut > 0 or held and held[-1].column("h")[0].as_py() != h[-1]:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]), False
            held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += len(batch)
        if size > HOT:
            yield pa.Table.from_batches(held), True
            held, size, crowded = [], 0, h[-1]
    if held:
        yield pa.Table.from_batches(held), False


def _collections(batches):
    """Answers of the segments of a task, which come by anchor, in collections of about BATCH; segments of hot anchors as they are."""
    held: list[tuple[list[bytes], np.ndarray, np.ndarray]] = []
    size = 0

    def solve():
        return _answers([s for part, _, _ in held for s in part], *(np.concatenate([x[k] for x in held]) for k in (1, 2)))

    for rows, crowded in _whole(batches):
        h, lo, hi = (rows.column(c).to_numpy() for c in ("h", "lo", "hi"))
        strings = rows.column("bytes").to_pylist()
        edge = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
        members = np.repeat(np.diff(edge), np.diff(edge))
        hot = (rows.column("salt").to_numpy() >= 0) | crowded | (members > HOT)
        alone = np.flatnonzero(~hot & (members == 1) & (lo != hi))  # one string: its transform has only its own windows; with one document, nothing
        many, hot = np.flatnonzero(~hot & (members > 1)), np.flatnonzero(hot)
        if len(hot):
            yield _hot([strings[k] for k in hot], lo[hot], hi[hot])
        if len(alone):
            yield _copies([strings[k] for k in alone], lo[alone])
        first = 0
        for end in [*(np.flatnonzero(h[many][1:] != h[many][:-1]) + 1).tolist(), len(many)]:
            if size + end - first >= BATCH or end == len(many) > first:
                own = many[first:end]
                held.append(([strings[k] for k in own], lo[own], hi[own]))
                size += end - first
                first = end
            if size >= BATCH:
                yield solve()
                held, size = [], 0
    if held:
        yield solve()


def _windows(batches):
    schema = ["gid", "a", "w", "lo", "hi"]
    for batch in batches:
        rows = [(xxhash.xxh3_128_digest(s), k, xxhash.xxh3_128_digest(s[k : k + N]), lo, hi) for s, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("bytes", "lo", "hi")), strict=True) for k in range(len(s) - N + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))], schema)


def _one_by_one(rows: DataFrame) -> DataFrame:
    """Answers of the segments of hot anchors, by grouping their windows."""
    rows = rows.groupBy("bytes").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    w = common.written(common.arrow_map(rows, _windows, "gid binary, a int, w binary, lo long, hi long"), "windows")
    least = common.written(w.groupBy("w").agg(F.min("lo").alias("first"), F.max("hi").alias("most")).filter("first < most").select("w", "first"), "least")
    return w.join(least, "w").filter("first < hi").select("gid", "a", F.col("a").alias("b"), "first")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, t (hash of the text) and spans (a, b) of the bytes that go, for the rows of docs that lose any, as a table."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("t", F.xxhash64("text"))
    both, often = screen.shared(rows, "text", anchor_hashes, SCREEN_BITS, OFTEN)
    twice, hot = sc.broadcast(both), sc.broadcast(often)
    found = _found(rows, twice, hot).repartition("h", "salt").groupBy("h", "salt", "bytes").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    solved = common.written(common.arrow_map(found.sortWithinPartitions("h").select("h", "salt", "bytes", "lo", "hi"), _collections, _ANSWER), "answers")
    answers = solved.filter("gid is not null").select("gid", "a", "b", "first")
    left = solved.filter("gid is null").select("bytes", "lo", "hi")
    used = [solved]
    if left.limit(1).count():
        used.append(common.written(_one_by_one(left), "one-by-one"))
        answers = answers.unionByName(used[-1])
    answered = sc.broadcast(screen.of_values(answers, "gid", SCREEN_BITS))
    places = _places(rows, twice, answered)
    # written first, so that Spark can split the places of a segment that very many documents have
    runs = common.written(answers.groupBy("gid").agg(F.collect_list(F.struct("a", "b", "first")).alias("runs")), "runs")
    met = places.join(runs, "gid").select("id", "t", "start", F.explode("runs").alias("run")).filter("run.first < id")
    spans = F.struct((F.col("start") + F.col("run.a")).alias("a"), (F.col("start") + F.col("run.b") + N).alias("b"))
    out = common.written(met.groupBy("id", "t").agg(F.collect_set(spans).alias("spans")), "spans")
    for table in (*used, runs):
        common.unwrite(table)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_bytes, n_removed, n_spans, kept (the bytes that are left).

    Ids must be integers. A null text has no bytes. Rows that repeat an id never take bytes from one another; rows with a
    null id lose nothing and take nothing. Empty docs give no rows; other columns are not read.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must be an integer")
    spans = repeated(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("t"), F.col(id_col).cast("long").alias("id"))
    rows = rows.join(spans, ["id", "t"], "left").select("__id", "__text", "spans")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                sizes, gone, runs, kept = [], [], [], []
                for text, spans in zip(common.binary_texts(part, "__text").cast(pa.binary()).to_pylist(), part.column("spans").to_pylist(), strict=True):
                    at, out, n, removed = 0, [], 0, 0
                    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                        if a > at or not n:
                            out.append(text[at:a])
                            n += 1
                            at = a
                        removed += max(0, b - at)
                        at = max(at, b)
                    out.append(text[at:])
                    sizes.append(len(text))
                    gone.append(removed)
                    runs.append(n)
                    kept.append(b"".join(out))
                yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], schema.names)

    return common.arrow_map(rows, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    x = dedup(common.spread(common.table(spark, sf_dir, "documents")))
    return x.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents
), b AS (
  SELECT doc_id, p, hex(x[p + 1:p + 1]) AS c, CASE WHEN p <= n - 50 THEN x[p + 1:p + 50] END AS s
  FROM (SELECT doc_id, x, octet_length(x) AS n, unnest(range(0, octet_length(x))) AS p FROM d)
), f AS (
  SELECT s, min(doc_id) AS first FROM b WHERE s IS NOT NULL GROUP BY s HAVING min(doc_id) < max(doc_id)
), w AS (
  SELECT b.doc_id, b.p, b.c, coalesce(f.first < b.doc_id, false) AS opens FROM b LEFT JOIN f ON f.s = b.s
), r AS (
  SELECT doc_id, p, c, bool_or(opens) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM w
), t AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM r
), a AS (
  SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
         string_agg(c, '' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM t GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""
