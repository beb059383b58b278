"""Screens: bitmaps of a fixed size that tell which of many hashes may occur in two documents.

A first pass over the documents sends each hash once a task, packed into a few binary rows for each range of hashes; the
task of a range sorts what it gets and marks the hashes that came twice. The marks of all ranges make the screen, whose size
is a parameter and not that of the input. A screen never misses a shared hash; what it lets through in error costs time only,
as exact joins follow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bits of the screens of frequent hashes.
HOT_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64, copy=False) * _MIX
    return h ^ (h >> np.uint64(32))


class Screen:
    """A bitmap over the top bits of mixed hashes."""

    def __init__(self, bits: int, marks: np.ndarray | None = None):
        self.bits = bits
        self.marks = np.zeros(1 << (bits - 3), np.uint8) if marks is None else marks

    def at(self, h: np.ndarray) -> np.ndarray:
        return (mixed(h) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        at = self.at(h)
        np.bitwise_or.at(self.marks, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        at = self.at(h)
        return (self.marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    h = np.sort(h)
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[start], np.diff(np.append(start, len(h)))


def shared(docs: DataFrame, text_col: str, hashes: Callable[[np.ndarray, np.ndarray], np.ndarray], bits: int, often: int = 1 << 62, most: int = 1_500_000) -> tuple[Screen, Screen]:
    """The screen of the hashes that two rows of docs have, and that of those which a task has `often` times in one go.

    hashes(bytes, starts) gives the hashes of a block of texts, each once a text.
    """
    spark = docs.sparkSession
    shards = min(1 << 14, 1 << max(3, (2 * common.shuffle_partitions(spark) - 1).bit_length()))
    top = np.uint64(64 - (shards.bit_length() - 1))

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, n = counted(np.concatenate(parts) if parts else np.zeros(0, np.uint64))
        order = np.argsort(mixed(values) >> top, kind="stable")
        values, n = values[order], n[order]
        edge = np.searchsorted(mixed(values) >> top, np.arange(shards + 1, dtype=np.uint64))
        ones, twos, many_ = [], [], []
        for k in range(shards):
            own, many = values[edge[k] : edge[k + 1]], n[edge[k] : edge[k + 1]] > 1
            ones.append(own[~many].tobytes())
            twos.append(own[many].tobytes())
            many_.append(own[n[edge[k] : edge[k + 1]] >= often].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), *(pa.array(x, pa.binary()) for x in (ones, twos, many_))], ["shard", "ones", "twos", "often"])

    def send(batches) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for _, _, raw, starts in common.byte_blocks(common.binary_texts(batch, "text")):
                parts.append(hashes(raw, starts))
                size += len(parts[-1])
                if size >= most:
                    yield packed(parts)
                    parts, size = [], 0
        if size:
            yield packed(parts)

    def mark(batches) -> Iterator[pa.RecordBatch]:
        for _, group in common.whole_groups(batches, "shard"):
            k = group.column("shard")[0].as_py()
            ones, twos, many = ([np.frombuffer(x, np.uint64) for x in group.column(c).to_pylist()] for c in ("ones", "twos", "often"))
            values, n = counted(np.concatenate([*ones, *twos, *twos]))
            s = Screen(bits)
            at = np.unique(s.at(values[n > 1])) - (k << (bits - shards.bit_length() + 1))
            chunk = np.zeros((1 << (bits - 3)) // shards, np.uint8)
            np.bitwise_or.at(chunk, at >> 3, (1 << (at & 7)).astype(np.uint8))
            hot = np.unique(Screen(HOT_BITS, np.zeros(1, np.uint8)).at(np.concatenate(many)))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([chunk.tobytes()], pa.binary()), pa.array([hot.tolist()], pa.list_(pa.int64()))], ["shard", "marks", "hot"])

    sent = common.arrow_map(docs.select(F.col(text_col).alias("text")), send, "shard int, ones binary, twos binary, often binary")
    out, hot = Screen(bits), Screen(HOT_BITS)
    size = len(out.marks) // shards
    dealt = sent.repartition(shards, "shard").sortWithinPartitions("shard")
    marks = common.written(common.arrow_map(dealt, mark, "shard int, marks binary, hot array<long>"), "marks")
    for row in marks.toLocalIterator():  # the screen's size in all
        out.marks[row["shard"] * size : (row["shard"] + 1) * size] = np.frombuffer(row["marks"], np.uint8)
        at = np.array(row["hot"], np.int64)
        np.bitwise_or.at(hot.marks, at >> 3, (1 << (at & 7)).astype(np.uint8))
    common.unwrite(marks)
    return out, hot


def of_values(df: DataFrame, column: str, bits: int) -> Screen:
    """The screen of a column of 64-bit hashes (longs, or the first 8 bytes of binary digests); the driver gets at most the screen's words."""

    def run(batches):
        for batch in batches:
            h = batch.column("h")
            h = h.to_numpy().view(np.uint64) if pa.types.is_integer(h.type) else np.array([int.from_bytes(x[:8], "little") for x in h.to_pylist()], np.uint64)
            at = Screen(bits, np.zeros(1, np.uint8)).at(h)
            word = np.unique(at >> 6)
            marks = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(marks, np.searchsorted(word, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(marks.view(np.int64))], ["word", "marks"])

    found = common.arrow_map(df.select(F.col(column).alias("h")).filter("h is not null"), run, "word long, marks long")
    got = found.groupBy("word").agg(F.bit_or("marks").alias("marks")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[got.column("word").to_numpy()] = got.column("marks").to_numpy()
    return Screen(bits, words.view(np.uint8))
