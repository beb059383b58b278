"""Exact dedup as a tree-merge of sorted digest runs, in DataFrame operations only.

Every row gets a digest of its normalised text and a run number. A run is first reduced to one entry a digest; then, in
rounds, run r takes the FAN - 1 runs that differ from it in the next bits of their number (four rounds of a binomial tree at
once where FAN is 16), a multiway merge that keeps the smallest identifier of a digest and its count, until one run is left.
Its answers go down the same tree to the rows. An entry of min(struct) type makes Spark merge by sort, so that runs are
sorted by digest and met in order. An entry is merged with another only if SHA-256, length and a second hash all agree.

No task ever holds a group of copies: at each level at most FAN entries share a key, and a leaf run is a bounded share of
the rows, so a group of copies that is a third of the table is met as a few entries a run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Runs merged at a time, and rows that a leaf run holds on average.
FAN, LEAF_ROWS = 16, 2048


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACE + "+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256 in hex) and check (length and a second, unlike hash) of each row's normalised text."""
    flat = normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), flat.alias("flat")).select(
        "doc_id",
        F.sha2("flat", 256).alias("digest"),
        F.struct(F.octet_length("flat").alias("n_bytes"), F.xxhash64("flat").alias("hash")).alias("check"),
    )


def tree_levels(rows: int, leaf_rows: int = LEAF_ROWS, fan: int = FAN) -> int:
    """Rounds of merges that bring rows / leaf_rows runs down to one."""
    return max(1, math.ceil(math.log(max(2, rows / leaf_rows), fan)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaf_rows: int = LEAF_ROWS, fan: int = FAN) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text equals empty text. A null id counts in its group and is kept only where the whole group has none. Rows that
    repeat an id with the same text count each, and all rows that carry the kept id are kept. An empty table gives no
    rows. Other columns are not read, whatever their names. Texts are held equal when digest, length and a second hash
    all agree.
    """
    rows = common.written(digests(docs, id_col, text_col), "digests")
    levels = tree_levels(rows.count(), leaf_rows, fan)
    top = fan**levels
    leaf = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(top))
    rows = rows.withColumn("run", leaf)
    key = ["run", "digest", "check"]
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"))).alias("best")
    runs = [rows.groupBy(key).agg(best, F.count(F.lit(1)).alias("n"))]
    for _ in range(levels):
        up = runs[-1].withColumn("run", F.floor(F.col("run") / fan))
        runs.append(up.groupBy(key).agg(F.min("best").alias("best"), F.sum("n").alias("n")))
    runs = [common.written(x, f"run{i}") if 0 < i else x for i, x in enumerate(runs)]
    answer = runs[-1].filter("n > 1").select("run", "digest", "check", "best", "n")
    for below in reversed(runs[1:-1]):
        entries = below.select(F.col("run").alias("own"), F.floor(F.col("run") / fan).alias("run"), "digest", "check")
        answer = entries.join(answer, key).select(F.col("own").alias("run"), "digest", "check", "best", "n")
    leaves = answer.withColumnRenamed("run", "parent")
    out = rows.withColumn("parent", F.floor(F.col("run") / fan)).join(leaves, ["parent", "digest", "check"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text an earlier id holds; all columns stay, and so do rows with a null id."""
    gone = exact_groups(docs, id_col, text_col).filter(~F.col("kept") & F.col("doc_id").isNotNull())
    digest = common.unused(docs, "digest")
    gone = gone.select(F.col("doc_id").alias(id_col), F.col("text_sha256").alias(digest)).distinct()
    marked = docs.withColumn(digest, F.sha2(normalised(F.col(text_col)), 256))
    return marked.join(gone, [id_col, digest], "left_anti").select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(common.table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT doc_id, text_sha256, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
