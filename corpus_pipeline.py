"""A training corpus in five stages: good documents, no copies, no near copies, no benchmark passages, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, common, decontaminate, exact_dedup, jaccard_join, quality


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels, doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest doc_id."""
    return exact_dedup.dedup(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id."""
    return jaccard_join.dedup(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word window of the benchmark."""
    return decontaminate.remove_documents(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the ids decoded again."""
    x = bpe.encode(docs, *bpe.production(), decoded=True)
    return x.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good),
    ("exact dedup", distinct),
    ("n-gram Jaccard join", unlike),
    ("benchmark decontamination", uncontaminated),
    ("byte-level BPE", tokens),
]

#: A fitted classifier and the merges of a vocabulary can't be put in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's result is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, common.written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
        if hasattr(last, "written_to"):
            common.unwrite(last)
    return STAGES[-1][1](spark, docs, sf_dir)
