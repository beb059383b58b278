"""Texts of a key joined in order, without gathering a key's rows."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import workers


def joined(df: DataFrame, key: str, order: Sequence[str | Column], line: Column, out: str, separator: str = " ", cap: int | None = None) -> DataFrame:
    """key and out: the lines of each key in order with a separator between, its first cap characters; null lines count as none.

    Rows are sorted within partitions, which can spill, and pass once as a stream; what is held of a key is the text so far, and
    no more of it than cap. A key whose lines are all null has the empty text; null keys are one key. Nulls come first in order.
    """
    workers.ship(df.sparkSession)
    places = {f"__o{k}": (F.col(c) if isinstance(c, str) else c) for k, c in enumerate(order)}
    rows = df.select(F.col(key).alias("__key"), line.cast("string").alias("__line"), *[c.alias(n) for n, c in places.items()])
    rows = rows.repartition("__key").sortWithinPartitions("__key", *places, "__line").select("__key", "__line")
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(out, T.StringType())])

    def run(batches):
        begun, now, parts, size, kind = False, None, [], 0, None
        done: list[tuple] = []

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], kind), pa.array([t for _, t in rows], pa.string())], schema.names)

        for batch in batches:
            kind = batch.schema.field("__key").type
            for first in range(0, len(batch), 4096):
                keys, lines = (batch.column(n).slice(first, 4096).to_pylist() for n in ("__key", "__line"))
                for k, text in zip(keys, lines, strict=True):
                    if not begun or k != now:
                        if begun:
                            done.append((now, "".join(parts)[:cap]))
                        begun, now, parts, size = True, k, [], 0
                    if text is not None and (cap is None or size < cap):
                        more = separator + text if parts else text
                        parts.append(more or "")
                        size += len(more)
                if len(parts) > 4096:
                    parts = ["".join(parts)]
                if len(done) >= 4096:
                    yield batch_of(done)
                    done = []
        if begun:
            done.append((now, "".join(parts)[:cap]))
            yield batch_of(done)

    return rows.mapInArrow(run, schema)
