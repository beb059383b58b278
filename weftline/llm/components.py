"""Connected components of links, by least labels and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label (the least node it is linked with, itself included) of every node of the links.

    Each round takes the least label beside each node, then the label's own label, so the rounds grow with the logarithm
    of a component's width. Counts of changed labels are all that the driver sees.
    """
    one = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = one.unionByName(one.select(F.col("other").alias("node"), F.col("node").alias("other")))
    both = common.written(both.filter("node <> other").distinct(), "links")
    table = common.written(both.groupBy("node").agg(F.min("other").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        labels = table.select("node", "label")
        beside = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("beside"))
        least = labels.join(beside, "node").select("node", F.col("label").alias("old"), F.least("label", "beside").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        after = least.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("above", "label")).alias("label"))
        before, table = table, common.written(after, "labels")
        common.unwrite(before)
        if not table.filter("label <> old").limit(1).count():
            common.unwrite(both)
            return table.select("node", "label")
