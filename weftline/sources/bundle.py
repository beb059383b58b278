"""Bundles: named tables in one directory, the counterpart of a workbook with sheets. All access goes through Spark's file systems."""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection
from datetime import UTC, datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import workbook


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path there is; raises if there is none."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {paths}")


def newest(spark: SparkSession, pattern: str) -> str:
    """The last path by name that fits a glob."""
    fs, p = _fs(spark, pattern)
    found = sorted(str(s.getPath()) for s in fs.globStatus(p) or [])
    if not found:
        raise FileNotFoundError(pattern)
    return found[-1]


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: parquet, csv (all text, with a header), json, jsonl or xlsx (its first sheet, all text); headers without blanks at their ends."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "csv":
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    elif kind in ("json", "jsonl"):
        df = spark.read.json(path)
    elif kind == "xlsx":
        df = workbook.read(spark, path)
    else:
        raise ValueError(f"no reader for .{kind}")
    return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])


#: How many blocks of files numbered() counts in the driver, a row each.
MOST_BLOCKS = 100_000


def numbered(spark: SparkSession, path: str, ordinal: str = "ordinal", multi_line: bool = True) -> DataFrame:
    """Rows of csv files, all text, with their place: files by path, and rows as they stand in them, counted from 0 through all files.

    Blocks of files are counted in one pass, when this is called, and numbered in another, each where it is read; no row is
    shuffled up to MOST_BLOCKS blocks, and beyond them rows meet their block's count by a shuffled join. A file is one block, as
    a quoted text may hold line ends; with multi_line off none does, and long files are split. Files must not change between
    the passes; without rows the result is empty.
    """
    df = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    names = [c.lstrip("\ufeff").strip() for c in df.columns]
    if ordinal in names:
        raise ValueError(f"there is a column {ordinal}")
    block = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")]
    spot = F.monotonically_increasing_id().alias("__spot")  # a task reads a block's rows one after another
    blocks = df.select(*block, spot).groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__spot").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__file", "__block")) - F.col("__n")
    shift = blocks.select("__file", "__block", (before - F.col("__first")).alias("__shift"))
    few = shift.limit(MOST_BLOCKS + 1).collect()
    if len(few) <= MOST_BLOCKS:
        shift = F.broadcast(spark.createDataFrame(few, shift.schema))
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)], *block, spot)
    return rows.join(shift, ["__file", "__block"]).select(*[f"`{n}`" for n in names], (F.col("__spot") + F.col("__shift")).alias(ordinal))


def _since(max_age_days: float, now: str | None) -> str:
    """The moment that is so long before now, as readers take it."""
    at = datetime.fromisoformat(now).replace(tzinfo=UTC) if now else datetime.now(UTC)
    return (at - timedelta(days=max_age_days)).strftime("%Y-%m-%dT%H:%M:%S")


def landed(spark: SparkSession, path: str, max_age_days: float | None = None, now: str | None = None, stream: bool = False) -> DataFrame:
    """path, modified and text of the files below a path or glob; with an age only those written within it before now (a timestamp's text in UTC; else the present).

    The age is applied as files are listed, to the second, so older ones aren't read. As a stream it gives each file once, as it lands.
    """
    reader = (spark.readStream if stream else spark.read).format("text").option("wholetext", True).option("recursiveFileLookup", True)
    if max_age_days is not None:
        reader = reader.option("modifiedAfter", _since(max_age_days, now)).option("timeZone", "UTC")
    if stream:
        reader = reader.schema("value string")
    df = reader.load(path)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def sections(spark: SparkSession, paths: dict[str, str], wanted: Collection[str] | None = None, max_age_days: float | None = None, now: str | None = None, stream: bool = False) -> DataFrame:
    """path, modified, text and section of the files of a source that comes in parts: section names to paths or globs, those without a file left out.

    Of the sections only those in wanted are listed and read. As a stream, sections (folders, which must be there) give files as they land.
    """
    out = None
    for name, path in paths.items():
        if wanted is not None and name not in wanted:
            continue
        fs, p = _fs(spark, path)
        if fs.globStatus(p):
            part = landed(spark, path, max_age_days, now, stream).withColumn("section", F.lit(name))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(str(paths))
    return out


def guarded(df: DataFrame) -> DataFrame:
    """df with every text safe to open in a spreadsheet."""
    return df.select(*[X.guarded(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in df.schema])


def _csv(writer, path: str) -> None:
    """Writes csv as read() takes it: a header, a quote in a text doubled, and blanks at a text's ends kept."""
    writer.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, f"{path}/manifests/*.json")
    return sorted(int(str(s.getPath().getName())[:-5]) for s in fs.globStatus(p) or [])


def version(spark: SparkSession, path: str) -> int:
    """The number of a bundle's last complete version: given to names() and table() it pins what they read."""
    found = _numbers(spark, path)
    if not found:
        raise FileNotFoundError(path)
    return found[-1]


def _manifest(spark: SparkSession, path: str, number: int | None) -> dict:
    fs, p = _fs(spark, f"{path}/manifests/{version(spark, path) if number is None else number}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, manifest: dict) -> int:
    """Makes a manifest the next version. It is written aside and renamed, which either happens or doesn't; a number that another writer took is passed over."""
    jvm = spark.sparkContext._jvm
    fs, aside = _fs(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    number = (_numbers(spark, path) or [0])[-1] + 1
    while True:
        to = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{number}.json")
        try:
            files.rename(fs.makeQualified(aside), fs.makeQualified(to), none)
            return number
        except Py4JJavaError:
            if not fs.exists(to):
                raise
            number += 1


def write(tables: dict[str, DataFrame], path: str, kind: str = "parquet", metrics: dict[str, Column] | None = None) -> dict[str, dict]:
    """Writes the next version of a bundle: tables in their own folders, texts guarded, and last a manifest that lists them in order.

    Readers see the version before it until the manifest is there, and all tables of the new one then; a write that fails leaves
    nothing that is read, and can be done again. The result has each table's number of rows, and the metrics (aggregates of
    those of its columns that it has); they are observed as the rows are written, without another pass, and kept in the manifest.
    """
    spark = next(iter(tables.values())).sparkSession
    folder, seen = uuid.uuid4().hex, {}
    for name, df in tables.items():
        watch = Observation()
        out = guarded(df).observe(watch, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in (metrics or {}).items() if _fits(df, c)]).write
        if kind == "csv":
            _csv(out, f"{path}/{folder}/{name}.csv")
        else:
            out.format(kind).save(f"{path}/{folder}/{name}.{kind}")
        seen[name] = watch.get
    listed = [{"name": n, "kind": kind, "path": f"{folder}/{n}.{kind}", "seen": {k: v if isinstance(v, (int, float, str, bool)) or v is None else str(v) for k, v in seen[n].items()}} for n in tables]
    _publish(spark, path, {"folder": folder, "tables": listed})
    return seen


def _fits(df: DataFrame, metric: Column) -> bool:
    """Whether a table has the columns that an aggregate needs."""
    try:
        return bool(df.limit(0).agg(metric).columns)
    except AnalysisException:
        return False


def seen(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """name, metric and value (text) of what was observed when a version was written."""
    rows = [(t["name"], k, None if v is None else str(v)) for t in _manifest(spark, path, number)["tables"] for k, v in t["seen"].items()]
    return spark.createDataFrame(rows, "name string, metric string, value string")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes the tables of all but the last `keep` versions, manifests first. Folders of writes that aren't finished stay."""
    fs, _ = _fs(spark, path)
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for number in _numbers(spark, path)[: -keep or None]:
        folder = _manifest(spark, path, number)["folder"]
        fs.delete(new(f"{path}/manifests/{number}.json"), False)
        fs.delete(new(f"{path}/{folder}"), True)


def write_both(df: DataFrame, path: str, kinds: tuple[str, ...] = ("parquet", "csv")) -> None:
    """A table in each of some formats: parquet as it is, csv and xlsx with guarded texts."""
    for kind in kinds:
        if kind == "xlsx":
            write_workbook({path.rsplit("/", 1)[-1][: workbook.MAX_NAME]: df}, f"{path}.xlsx")
        elif kind == "csv":
            _csv(guarded(df).write.mode("overwrite"), f"{path}.csv")
        else:
            df.write.mode("overwrite").format(kind).save(f"{path}.{kind}")


def write_workbook(tables: dict[str, DataFrame], path: str) -> None:
    """Tables as the sheets of one .xlsx file, texts guarded, with frozen headers, filters and fitted columns."""
    workbook.write({name: guarded(df) for name, df in tables.items()}, path)


def write_views(df: DataFrame, path: str, views: dict[str, Column], kind: str = "parquet") -> None:
    """A bundle of a table, named `all`, and of its rows for each named condition, a null one counting as false."""
    write({"all": df} | {name: df.filter(F.coalesce(c, F.lit(False))) for name, c in views.items()}, path, kind)


def append_log(df: DataFrame, path: str, fields: list[str]) -> None:
    """Appends some columns, in order, to a log in csv; each part has a header, so read() gives the rows alone."""
    _csv(df.select(*fields).write.mode("append"), path)


def names(spark: SparkSession, path: str, number: int | None = None) -> list[tuple[str, str]]:
    """Names and kinds of the tables of a bundle's version (the last unless given), in order; of a workbook, its sheets."""
    if path.lower().endswith(".xlsx"):
        return [(name, "xlsx") for name in workbook.names(spark, path)]
    return [(t["name"], t["kind"]) for t in _manifest(spark, path, number)["tables"]]


def table(spark: SparkSession, path: str, name: str | None = None, skip: tuple[str, ...] = ("summary", "readme"), number: int | None = None) -> DataFrame:
    """The named table, or (if there's none of that name) the first whose name has no word of skip, else the first; of a version, the last unless given."""
    book = path.lower().endswith(".xlsx")
    listed = {n: None for n, _ in names(spark, path)} if book else {t["name"]: t["path"] for t in _manifest(spark, path, number)["tables"]}
    if name not in listed:
        name = next((n for n in listed if not any(s in n.lower() for s in skip)), next(iter(listed)))
    return workbook.read(spark, path, name) if book else read(spark, f"{path}/{listed[name]}")
