"""Resumable runs over an append-only result store, in batch and as a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import workers
from ..operators import cascade, dedupe
from ..sources import bundle


def load(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """The store's last row of each key (by seq); lines that don't parse are skipped; an absent store is empty."""
    if not bundle.exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path).filter(F.col(key).isNotNull())
    return dedupe.keep_last(rows, [key], "seq")


def pending(inputs: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Inputs whose key the store lacks, the first row of each key."""
    return dedupe.keep_first(inputs.join(store.select(key), key, "left_anti"), [key], "ordinal")


def write_back(rows: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """All rows with the result of their key (one a key); blank where there is none yet."""
    more = [c for c in results.columns if c != key]
    out = rows.join(results, key, "left")
    return out.na.fill("", [f.name for f in results.schema if f.name in more and f.dataType.simpleString() == "string"])


def rows_from(df: DataFrame, ordinal: str, start: int = 0, limit: int | None = None) -> DataFrame:
    """limit rows (all without one) from the start-th on, in order."""
    out = df.orderBy(ordinal).offset(start)
    return out if limit is None else out.limit(limit)


@dataclass(frozen=True)
class Switches:
    """What a run of the listing cascade uses. Quotes and entities come from searches: a source that is off, or any search offline,
    gives no scores. A row without a match is private only if that is asked for, and is up for review otherwise."""

    offline: bool = False
    quotes: bool = True
    entities: bool = True
    no_match_is_private: bool = False

    def listing(self, name: Column, override: Column, direct: Column, quote: Column, firm: Column, entity: Column, parent: Column) -> Column:
        """cascade.listing_status() over the sources that are on; quote is the best score of a quote search, which is a direct match too."""
        none = F.lit(None).cast("double")
        found = self.entities and not self.offline
        direct = F.greatest(direct, quote) if self.quotes and not self.offline else direct
        return cascade.listing_status(name, override, direct, firm, entity if found else none, parent if found else none, self.no_match_is_private)


def run(spark: SparkSession, inputs: DataFrame, path: str, schema: T.StructType, key: str, work: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
    """Does what is pending, appends it, and gives the store; force starts anew."""
    if force and bundle.exists(spark, path):
        fs, p = bundle._fs(spark, path)
        fs.delete(p, True)
    done = load(spark, path, schema, key)
    work(pending(inputs, done, key)).select(*schema.names).write.mode("append").json(path)
    return load(spark, path, schema, key)


class _Firsts(StatefulProcessor):
    """Of each key the first row (by ordinal) of the first micro-batch that has it; keys of the initial state have had theirs."""

    def __init__(self, ordinal: str, schema: T.StructType, ttl_ms: int | None):
        self.ordinal, self.schema, self.ttl_ms = ordinal, schema, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "done boolean", self.ttl_ms) if self.ttl_ms else handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        first = None
        for part in rows:
            own = part.sort_values(self.ordinal, na_position="last", kind="stable").iloc[:1]
            first = own if first is None else pd.concat([first, own]).sort_values(self.ordinal, na_position="last", kind="stable").iloc[:1]
        if first is not None and not self.done.exists():
            self.done.update((True,))
            yield first

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self.done.update((True,))

    def close(self) -> None:
        pass


_STORES = "spark.sql.streaming.stateStore.providerClass"


def stream(source: DataFrame, path: str, checkpoint: str, key: str, schema: T.StructType, work: Callable[[DataFrame], DataFrame], ordinal: str = "ordinal", ttl_days: float | None = None):
    """run() over a streaming source: does and appends the first row of each key that is new.

    Which keys are done is keyed state of the query; the store is read once, when the query first starts, to set it up. So a
    micro-batch's work doesn't depend on the store's size. A micro-batch writes to a folder of its own, named after query and
    batch, and one that is run again after a failure writes it anew: no result is doubled. With ttl_days a key may be done again
    when so much time has passed. Rows without a key are left out.
    """
    spark = source.sparkSession
    workers.ship(spark)
    keys = T.StructType([schema[key], schema["seq"]])  # of the store's rows no more than this is read
    done = load(spark, path, keys, key).select(key).groupBy(key)
    ttl_ms = None if ttl_days is None else int(ttl_days * 86_400_000)
    new = source.filter(F.col(key).isNotNull()).groupBy(key).transformWithStateInPandas(
        _Firsts(ordinal, source.schema, ttl_ms), source.schema, "Append", "ProcessingTime" if ttl_ms else "None", initialState=done)

    def each(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        work(batch).select(*schema.names).write.mode("overwrite").json(f"{path}/stream-{query}-{number}")

    before = spark.conf.get(_STORES, None)
    spark.conf.set(_STORES, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return new.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORES, before) if before else spark.conf.unset(_STORES)


def compact(spark: SparkSession, path: str, schema: T.StructType, key: str) -> None:
    """Rewrites a store as the last row of each key. What is appended meanwhile stays; if it ends half way, load() gives the same rows."""
    if not bundle.exists(spark, path):
        return
    fs, p = bundle._fs(spark, path)
    old = [s.getPath() for s in fs.listStatus(p)]
    load(spark, path, schema, key).write.json(f"{path}/compact-{uuid.uuid4().hex}")
    for part in old:
        fs.delete(part, True)


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event-time window with a watermark, for batch and stream alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
