"""Incremental, reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

The index has three tables. refs: each key (16-byte hash of a line's key) with the number of documents that hold it and the
smallest of them; pairs: which document holds which key, so that deletions can be undone exactly; filters: a cuckoo filter
for each shard of the keys. A shard takes what arrives in batches: what its filter doesn't know is new and goes straight
into its table, what the filter knows is looked up there and only then counted. Deleting documents takes their counts and
fingerprints out again. Insertions and deletions write the shards that they hit and no others.

Keys are equal when the 128-bit hashes of the lines' keys are: among a million million lines two unlike ones meet with a
chance of about one in 10^15.

Keys are counted before they are dealt out (a batch of documents sends a key once), so a line that is in a third of all
documents reaches its shard as a few rows; the few keys that hold more than a HEAVY-th of all pairs are joined by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .cuckoo import Cuckoo, Full

MIN_POINTS, HEAVY = 10, 5000
#: Pairs of document and key for each shard: what a task holds grows with this and not with the input.
SHARD_PAIRS = 500_000
STRIP = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and their keys, None for a key of under MIN_POINTS code points."""
    lines = text.split(b"\n")
    keys = []
    for line in lines:
        key = line.strip(STRIP).lower()  # of bytes: A-Z only
        if len(key) < MIN_POINTS or len(key) < 4 * MIN_POINTS and len(key.decode()) < MIN_POINTS:
            keys.append(None)
        else:
            keys.append(xxhash.xxh3_128_digest(key))
    return lines, keys


def line_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and key, once for each key that a document holds; rows with a null id hold none."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("key", T.BinaryType())])

    def run(batches):
        for batch in batches:
            texts = common.binary_texts(batch, "__text").cast(pa.binary())
            for first in range(0, len(batch), 512):
                rows, keys = [], []
                for k, text in enumerate(texts.slice(first, 512).to_pylist(), first):
                    own = set(line_keys(text)[1])
                    own.discard(None)
                    rows += [k] * len(own)
                    keys += own
                yield pa.RecordBatch.from_arrays([batch.column("__id").take(pa.array(rows, pa.int32())), pa.array(keys, pa.binary())], ["doc_id", "key"])

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return common.arrow_map(rows, run, schema)


class Shard:
    """One shard: a cuckoo filter of its keys and their exact table of (documents, smallest document)."""

    def __init__(self, filter_bytes: bytes | None = None, table: dict | None = None):
        self.table = table or {}
        self.filter = Cuckoo.from_bytes(filter_bytes) if filter_bytes else Cuckoo(1024)
        self.confirmed = self.doubted = 0

    @staticmethod
    def marks(keys: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(keys), "<u8")[::2]

    def _grow(self) -> None:
        size = max(1024, 2 * self.filter.capacity)
        while True:
            self.filter = Cuckoo(size)
            try:
                self.filter.insert(self.marks(list(self.table)))
                return
            except Full:
                size *= 2

    def insert(self, keys: list[bytes], refs: list[int], firsts: list) -> None:
        """Counts refs documents, the smallest of which is the key's first, for each key; keys may repeat."""
        batch: dict = {}
        for key, n, first in zip(keys, refs, firsts, strict=True):
            if key in batch:  # repeats within a batch are combined first
                own = batch[key]
                n, first = own[0] + n, min(own[1], first)
            batch[key] = (n, first)
        keys, table = list(batch), self.table
        known = self.filter.contains(self.marks(keys))
        new = [keys[k] for k in np.flatnonzero(~known)]
        seen = [keys[k] for k in np.flatnonzero(known)]
        for key in seen:  # the filter may err: the exact table decides
            if (own := table.get(key)) is None:
                self.doubted += 1
                new.append(key)
            else:
                self.confirmed += 1
                batch[key] = (own[0] + batch[key][0], min(own[1], batch[key][1]))
        table.update(batch)
        try:
            self.filter.insert(self.marks(new))
        except Full:
            self._grow()

    def delete(self, keys: list[bytes]) -> None:
        """Takes keys that no document holds any more out of table and filter."""
        gone = [k for k in keys if self.table.pop(k, None) is not None]
        if gone:
            self.filter.delete(self.marks(gone))


@dataclass
class Index:
    pairs: DataFrame  # doc_id, key
    refs: DataFrame  # shard, key, refs, first
    filters: DataFrame  # shard, cells
    shards: int


def shard_of(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _run_shards(counted: DataFrame, shards: int, doc_type) -> DataFrame:
    """The shards' tables and filters (a row with a null key) made of rows (shard, key, refs, first); a task takes its shards one by one."""
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("refs", T.LongType()), T.StructField("first", doc_type), T.StructField("cells", T.BinaryType())])
    arrow_type = {"string": pa.string()}.get(doc_type.simpleString(), pa.int64())

    def out(shard: int, s: Shard) -> Iterator[pa.RecordBatch]:
        keys = list(s.table)
        for k in range(0, len(keys), 20000):
            part = keys[k : k + 20000]
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(part), pa.int32()), pa.array(part, pa.binary()), pa.array([s.table[x][0] for x in part], pa.int64()), pa.array([s.table[x][1] for x in part], arrow_type), pa.nulls(len(part), pa.binary())], schema.names)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, arrow_type), pa.array([s.filter.to_bytes()], pa.binary())], schema.names)

    def run(batches):
        now, s = None, None
        for batch in batches:
            ids = batch.column("shard").to_numpy()
            for a, b in zip(edges := [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist()], [*edges[1:], len(ids)], strict=True):
                if a == b:
                    continue
                if int(ids[a]) != now:
                    if s:
                        yield from out(now, s)
                    now, s = int(ids[a]), Shard()
                part = batch.slice(a, b - a)
                s.insert(part.column("key").to_pylist(), part.column("refs").to_pylist(), part.column("first").to_pylist())
        if s:
            yield from out(now, s)

    dealt = counted.repartition(shards, "shard").sortWithinPartitions("shard").select("shard", "key", "refs", "first")
    return common.arrow_map(dealt, run, schema)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> Index:
    """The index of docs; there are as many shards as hold about SHARD_PAIRS pairs each, so that a task's table is bounded."""
    spark = docs.sparkSession
    pairs = common.written(line_pairs(docs, id_col, text_col), "pairs")
    shards = shards or max(common.shuffle_partitions(spark), -(-pairs.count() // SHARD_PAIRS))
    part = pairs.select(shard_of(shards).alias("shard"), "key", "doc_id", F.spark_partition_id().alias("p"))
    counted = part.groupBy("shard", "key", F.pmod("p", F.lit(16)).alias("p")).agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first"))
    state = common.written(_run_shards(counted, shards, pairs.schema["doc_id"].dataType), "refs")
    return Index(pairs, state.filter("key is not null").drop("cells"), state.filter("key is null").select(F.col("shard").alias("shard"), F.col("cells").alias("cells")), shards)


def _split(df: DataFrame, hit: list[int]) -> tuple[DataFrame, DataFrame]:
    """The rows of the shards that are hit, and the others, as they are stored."""
    return df.filter(F.col("shard").isin(hit)), df.filter(~F.col("shard").isin(hit))


def _hit(df: DataFrame) -> list[int]:
    """The shards of df's rows: numbers under the index's count of shards."""
    return sorted(r[0] for r in df.select("shard").distinct().collect())


def insert(index: Index, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index with the documents of docs, whose ids must be new to it, added.

    Each shard's filter tells which of the new keys it can't hold; only the others are looked up in the exact table. Shards
    without a new key stay as they are stored, and so do the pairs that there were; compact() brings all into single tables.
    """
    more = common.written(line_pairs(docs, id_col, text_col), "pairs")
    counted = more.groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first")).withColumn("shard", shard_of(index.shards))
    flag = T.StructType([*counted.select("shard", "key", "refs", "first").schema, T.StructField("maybe", T.BooleanType())])

    def probe(new: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        f = Cuckoo.from_bytes(own["cells"].iloc[0]) if len(own) else None
        maybe = f.contains(Shard.marks(list(new["key"]))) if f and len(new) else np.zeros(len(new), bool)
        return new.assign(maybe=maybe)[flag.names]

    probed = counted.select("shard", "key", "refs", "first").groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(probe, flag)
    probed = common.written(probed, "probed")
    hit = _hit(probed)
    on, off = _split(index.refs.select("shard", "key", "refs", "first"), hit)
    asked = probed.filter("maybe").drop("maybe")
    met = common.written(asked.join(on.select("key", F.col("refs").alias("r"), F.col("first").alias("f")), "key", "left"), "met")  # the filter may err: r is null then
    known = met.filter("r is not null").select("shard", "key", (F.col("refs") + F.col("r")).alias("refs"), F.least("first", "f").alias("first"))
    new = probed.filter("not maybe").drop("maybe").unionByName(met.filter("r is null").select("shard", "key", "refs", "first"))
    changed = common.written(on.join(known.select("key"), "key", "left_anti").select(*known.columns).unionByName(known).unionByName(new), "refs")
    filters, others = _split(index.filters, hit)
    return Index(index.pairs.unionByName(more), off.unionByName(changed), others.unionByName(_grown(filters, new, changed)), index.shards)


def _grown(filters: DataFrame, new: DataFrame, refs: DataFrame) -> DataFrame:
    """The filters with the keys that are new; a filter that is full is built again, twice as large, from its exact table."""
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("cells", T.BinaryType())])

    def put(key, added: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        f = Cuckoo.from_bytes(cells["cells"].iloc[0]) if len(cells) else Cuckoo(1024)
        try:
            f.insert(Shard.marks(list(added["key"])) if len(added) else np.zeros(0, np.uint64))
        except Full:
            return pd.DataFrame({"shard": [key[0]], "cells": [None]})
        return pd.DataFrame({"shard": [key[0]], "cells": [f.to_bytes()]})

    def again(key, own: pd.DataFrame) -> pd.DataFrame:
        s = Shard(None, dict.fromkeys(own["key"]))
        s._grow()
        return pd.DataFrame({"shard": [key[0]], "cells": [s.filter.to_bytes()]})

    grown = common.written(new.select("shard", "key").groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(put, schema), "filters")
    full = _hit(grown.filter("cells is null"))
    if not full:
        return grown
    larger = refs.filter(F.col("shard").isin(full)).select("shard", "key").groupBy("shard").applyInPandas(again, schema)
    return grown.filter("cells is not null").unionByName(common.written(larger, "filters"))


def delete(index: Index, ids: DataFrame, id_col: str = "doc_id") -> Index:
    """The index without the documents whose ids are given, as if they had never been inserted.

    Only the shards of their keys are written anew; their pairs are left out when pairs are read, until compact().
    """
    gone = common.written(ids.select(F.col(id_col).alias("doc_id")).distinct(), "gone")
    left = index.pairs.join(gone, "doc_id", "left_anti")
    hurt = index.pairs.join(gone, "doc_id", "left_semi").select("key").distinct().withColumn("shard", shard_of(index.shards))
    hurt = common.written(hurt, "hurt")
    hit = _hit(hurt)
    again = left.join(hurt.select("key"), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first"))
    again = common.written(again.withColumn("shard", shard_of(index.shards)).select("shard", "key", "refs", "first"), "again")
    on, off = _split(index.refs.select("shard", "key", "refs", "first"), hit)
    changed = common.written(on.join(hurt.select("key"), "key", "left_anti").select(*again.columns).unionByName(again), "refs")
    dead = hurt.join(again.select("key"), "key", "left_anti").select("shard", "key")
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("cells", T.BinaryType())])

    def take(key, own: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        f = Cuckoo.from_bytes(cells["cells"].iloc[0])
        if len(own):
            f.delete(Shard.marks(list(own["key"])))
        return pd.DataFrame({"shard": [key[0]], "cells": [f.to_bytes()]})

    filters, others = _split(index.filters, hit)
    taken = common.written(dead.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(take, schema), "filters")
    return Index(left, off.unionByName(changed), others.unionByName(taken), index.shards)


def compact(index: Index) -> Index:
    """The same index in three tables, after many insertions and deletions."""
    return Index(common.written(index.pairs, "pairs"), common.written(index.refs, "refs"), common.written(index.filters, "filters"), index.shards)


def drops(index: Index) -> DataFrame:
    """doc_id and key of the lines that go: held by two documents at least, and by a smaller one."""
    shared = index.refs.filter("refs > 1").select("key", "refs", "first")
    total = max(1, index.pairs.count())
    heavy = F.broadcast(shared.filter(F.col("refs") > total / HEAVY).select("key", F.col("first").alias("own")))  # under HEAVY keys
    marked = index.pairs.join(heavy, "key", "left")
    quick = marked.filter("own is not null and doc_id <> own").select("doc_id", "key")
    rest = marked.filter("own is null").select("doc_id", "key")
    slow = rest.join(shared.filter(F.col("refs") <= total / HEAVY), "key").filter("doc_id <> first").select("doc_id", "key")
    return quick.unionByName(slow)


def kept(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_lines, n_dropped, kept (the text that is left).

    A null or empty text is one empty line. Rows that repeat an id are one document: all keep their lines if they hold
    them first. Rows with a null id neither lose lines nor count as holders. Empty docs give no rows; other columns are
    not read.
    """
    by_doc = drops(index).groupBy("doc_id").agg(F.collect_list("key").alias("__drop")).withColumnRenamed("doc_id", "__id")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(by_doc, "__id", "left").select("__id", "__text", "__drop")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])

    def run(batches):
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                texts = common.binary_texts(part, "__text").cast(pa.binary()).to_pylist()
                lines, dropped, left = [], [], []
                for text, drop in zip(texts, part.column("__drop").to_pylist(), strict=True):
                    if drop:
                        gone = set(drop)
                        own, keys = line_keys(text)
                        stay = [x for x, key in zip(own, keys, strict=True) if key is None or key not in gone]
                        lines.append(len(own))
                        dropped.append(len(own) - len(stay))
                        left.append(b"\n".join(stay).decode())
                    else:
                        lines.append(text.count(b"\n") + 1)
                        dropped.append(0)
                        left.append(text.decode())
                yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(left, pa.string())], schema.names)

    return common.arrow_map(rows, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.spread(common.table(spark, sf_dir, "documents"))
    return kept(docs, build(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH l AS (
  SELECT doc_id, n, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, generate_subscripts(a, 1) AS n, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))
), k AS (
  SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT l.doc_id, l.n, l.line, k.key IS NOT NULL AND l.doc_id <> k.first AS gone FROM l LEFT JOIN k ON l.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
