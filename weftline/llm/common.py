"""Pieces that the operators of this package share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import workers

SPACE = "[\\x20\\x09-\\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: only an input of fewer, which is a small one, is dealt anew."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does just that, and faster, where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    """True for a document that no model may learn from; a null id is not held out, and nothing is learned from it."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one only where it is unset, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top}/weftline-{spark.sparkContext.applicationId}"


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with this package at hand in the workers."""
    workers.ship(df.sparkSession)
    return df.mapInArrow(run, schema)


_roots: set[str] = set()


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _sweep(spark: SparkSession, root: str) -> None:
    try:
        drop_path(spark, root)
    except Exception:  # the session has ended already
        return


#: Has Spark delete an execution's shuffle files as soon as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and a lost executor costs a reread only.

    The shuffle files behind the table go when it is complete.
    """
    spark = df.sparkSession
    root = shared_dir(spark)
    if root not in _roots:
        _roots.add(root)
        atexit.register(_sweep, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def unwrite(df: DataFrame) -> None:
    """Deletes the table behind a written() frame that nothing will read again."""
    drop_path(df.sparkSession, df.written_to)


def unused(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores before it as make it none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(df: DataFrame, key: str, cap: int, stratum: str | None = None, max_strata: int = 1000) -> DataFrame:
    """About cap rows (a stratum), chosen by a hash of key, so that every run and any order of rows gives the same ones.

    Where keys repeat so often that the chosen ones have over 1.25 times cap rows, a limit keeps the sample bounded, and which of
    them stay is then up to the run.
    """
    spread = F.pmod(F.xxhash64(F.lit(17), F.col(key).cast("string")), F.lit(1_000_000))
    if stratum is None:
        total = max(1, df.count())
        return df.filter(spread < int(1e6 * cap / total) + 1).limit(cap + cap // 4)
    counts = df.groupBy(stratum).count().limit(max_strata + 1).collect()
    if len(counts) > max_strata:
        raise ValueError(f"more than {max_strata} values of {stratum}")
    bound = F.lit(0)
    for r in counts:
        bound = F.when(F.col(stratum) == r[0], int(1e6 * cap / r[1]) + 1).otherwise(bound)
    return df.filter(spread < bound).limit((cap + cap // 4) * max(1, len(counts)))


def binary_texts(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A text column as UTF-8 bytes, null as none."""
    texts = batch.column(column)
    return pc.fill_null(texts, "") if texts.null_count else texts


def byte_blocks(texts: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about limit bytes, a longer text alone: first row, end row, their bytes, and where each row starts in these (and the end)."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield first, end, raw[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


#: Bytes of a text that numpy works on at a time: what a very long text takes in memory is a few dozen times this.
PIECE = 4 << 20


def word_pieces(raw: np.ndarray, word: Callable[[np.ndarray], np.ndarray], before: int, piece: int | None = None) -> Iterator[tuple[int, int, int]]:
    """First byte, end, and words to skip, of the pieces of one text in which whole words lie, each with `before` words of the last.

    word(bytes) tells, of the bytes of a stretch, where a word begins; its first byte begins one. A word that is longer than a
    piece stays whole.
    """
    piece = piece or PIECE
    starts = [np.flatnonzero(word(raw[k : k + piece + 1])) + k for k in range(0, len(raw), piece)]
    begin = np.unique(np.concatenate([starts[0], *[x[x > k] for k, x in zip(range(piece, len(raw), piece), starts[1:], strict=True)], *[x[x == k] for k, x in zip(range(piece, len(raw), piece), starts, strict=False)]]))
    first = 0
    while first < len(begin):
        end = max(first + 1, int(np.searchsorted(begin, begin[first] + piece)))
        yield int(begin[max(0, first - before)]), int(begin[end]) if end < len(begin) else len(raw), min(first, before)
        first = end


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs of values that starts (with the end) delimits; empty runs give 0."""
    out = np.zeros(len(starts) - 1, np.float64)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, starts[full], dtype=np.float64)
    return out


def whole_groups(batches, key: str) -> Iterator[tuple[object, pa.RecordBatch]]:
    """Key and rows of each group of a sorted run of batches; a group that batches cut is put together again."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        ids = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        if rest and rest[0].column(key)[0].as_py() != ids[0]:
            yield rest[0].column(key)[0].as_py(), pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            rest = []
        edges = [0, *cuts.tolist(), len(ids)]
        for a, b in zip(edges, edges[1:], strict=False):
            part = batch.slice(a, b - a)
            if b == len(ids):
                rest.append(part)
            elif rest:
                yield ids[a], pa.Table.from_batches([*rest, part]).combine_chunks().to_batches()[0]
                rest = []
            else:
                yield ids[a], part
    if rest:
        yield rest[0].column(key)[0].as_py(), pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
