"""The registered queries against their SQL at the smallest scale, and the pipeline against its parts."""

import os

import pytest

from tests.test_entry import SF, same
from weftline.llm import decontaminate, exact_dedup, jaccard_join, registry

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, name, registry.queries()[name], registry.oracle_sql()[name])


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, left, SF)
        assert after.columns == docs.columns
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        before = {r["doc_id"] for r in left.select("doc_id").collect()}
        if name == "exact dedup":
            want = {r["doc_id"] for r in exact_dedup.exact_groups(left).filter("kept").collect()}
        elif name == "n-gram Jaccard join":
            want = {r["doc_id"] for r in jaccard_join.jaccard_components(left).filter("doc_id = component_id").collect()}
        elif name == "benchmark decontamination":
            want = {r["doc_id"] for r in decontaminate.report(left, spark.read.parquet(f"{SF}/benchmark.parquet")).filter("not contaminated").collect()}
        else:
            bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
            assert len(before - ids) > 0 and len((before - ids) - bad) <= 0.2 * len(before)
            want = ids
        assert ids == want and ids <= before
        left = after
    out = p.run(spark, SF)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == ids
