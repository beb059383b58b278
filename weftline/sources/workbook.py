"""Workbooks (.xlsx) as source and sink, with the zip and XML of the standard library alone.

Executors parse a file, sheet by sheet, from Spark's binaryFile reader; the driver writes one as a stream, row by row, to any of
Spark's file systems. A sheet is bounded by its format (1,048,576 rows); larger tables belong in a bundle.
"""

from __future__ import annotations

import datetime as dt
import io
import itertools
import json
import math
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import workers

# The bounds of the format, and its own number formats that show a date or a time.
MAX_ROWS, MAX_COLUMNS, MAX_CHARS, MAX_NAME = 1_048_576, 16_384, 32_767, 31
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}

#: Rows of a parsed sheet in one Arrow batch.
_BATCH = 1000


def _tag(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _attribute(node, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _text(node) -> str:
    """The text of a string with its runs, readings of signs (rPh) left out."""
    if _tag(node) == "t":
        return node.text or ""
    return "".join(_text(c) for c in node if _tag(c) in ("r", "t"))


def _tree(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else ElementTree.Element("none")


def _parts(z: zipfile.ZipFile) -> dict[str, str]:
    """Names of sheets, in order, to the files they are in."""
    to = {r.get("Id"): r.get("Target") for r in _tree(z, "xl/_rels/workbook.xml.rels")}
    sheets = [s for s in _tree(z, "xl/workbook.xml").iter() if _tag(s) == "sheet"]
    found = {s.get("name"): next((v for k, v in s.attrib.items() if k.endswith("}id")), None) for s in sheets}
    return {name: to[i].lstrip("/") if to[i].startswith("/") else f"xl/{to[i]}" for name, i in found.items() if i in to}


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """The cell styles whose number format shows a date or a time."""
    root = _tree(z, "xl/styles.xml")
    own = {}
    for f in root.iter():
        if _tag(f) == "numFmt":
            bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", ""))
            own[int(f.get("numFmtId"))] = bool(re.search(r"[ymdhs]", bare, re.I)) and bare.lower() != "general"
    formats = [int(x.get("numFmtId", 0)) for xfs in root if _tag(xfs) == "cellXfs" for x in xfs]
    return {k for k, f in enumerate(formats) if own.get(f, f in DATE_FORMATS)}


def moment(serial: float, since_1904: bool = False) -> str:
    """The text of a date's number: a date, a date and time, or (below one day) a time."""
    if 0 <= serial < 1 and not since_1904:
        return str((dt.datetime(1900, 1, 1) + dt.timedelta(seconds=round(serial * 86400))).time())
    first = dt.datetime(1904, 1, 1) if since_1904 else dt.datetime(1899, 12, 31 if serial < 60 else 30)
    at = first + dt.timedelta(days=int(serial), seconds=round(serial % 1 * 86400))
    return str(at if at.time() != dt.time() else at.date())


def _column(ref: str) -> int:
    n = 0
    for c in ref.rstrip("0123456789"):
        n = n * 26 + ord(c) - 64
    return n - 1


def rows(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows with a cell of a sheet (the first one unless named), as texts; empty cells and errors are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = _parts(z)
        if sheet is not None and sheet not in parts:
            raise KeyError(f"no sheet {sheet}")
        strings = [_text(s) for s in _tree(z, "xl/sharedStrings.xml") if _tag(s) == "si"]
        dates = _date_styles(z)
        since_1904 = any(_attribute(p, "date1904") in ("1", "true") for p in _tree(z, "xl/workbook.xml") if _tag(p) == "workbookPr")

        def value(cell) -> str | None:
            kind = cell.get("t", "n")
            if kind == "inlineStr":
                return next((_text(x) for x in cell if _tag(x) == "is"), None)
            raw = next((x.text for x in cell if _tag(x) == "v"), None)
            if raw is None or kind == "e":
                return None
            if kind == "s":
                return strings[int(raw)]
            if kind == "b":
                return "true" if raw == "1" else "false"
            if kind == "n" and int(cell.get("s", 0)) in dates:
                return moment(float(raw), since_1904)
            return raw

        with z.open(parts[sheet] if sheet is not None else next(iter(parts.values()))) as f:
            data = None
            for event, node in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    data = node if _tag(node) == "sheetData" else data
                elif _tag(node) == "row":
                    out: list[str | None] = []
                    for cell in (c for c in node if _tag(c) == "c"):
                        at = _column(cell.get("r")) if cell.get("r") else len(out)
                        out += [None] * (at - len(out))
                        out.append(value(cell))
                    if any(v is not None for v in out):
                        yield out
                    data.clear()


def _content(spark: SparkSession, path: str) -> DataFrame:
    workers.ship(spark)
    return spark.read.format("binaryFile").load(path).select("content")


def names(spark: SparkSession, path: str) -> list[str]:
    """The sheets of a workbook, in order."""

    def run(batches):
        for batch in batches:
            for c in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(c.as_py())) as z:
                    found = list(_parts(z))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], ["ordinal", "name"])

    return [r["name"] for r in sorted(_content(spark, path).mapInArrow(run, "ordinal int, name string").collect())]


def headers(cells: list[str | None]) -> list[str]:
    """Names of columns from a first row: trimmed, empty ones numbered, and repeated ones (in any case) told apart."""
    out: list[str] = []
    taken: set[str] = set()
    for k, cell in enumerate(cells):
        name = base = (cell or "").strip() or f"Unnamed: {k}"
        for n in itertools.count(1):
            if name.lower() not in taken:
                break
            name = f"{base}.{n}"
        taken.add(name.lower())
        out.append(name)
    return out


def read(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet (the first one unless named) as text columns named by its first row; rows without any cell are left out.

    Cells to the right of the first row's are not read. A sheet without rows gives no columns; an unknown name raises.
    """

    def run(most):
        def run_(batches):
            for batch in batches:
                for c in batch.column("content"):
                    found = itertools.islice(rows(c.as_py(), sheet), most)
                    while part := list(itertools.islice(found, _BATCH)):
                        yield pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.string()))], ["cells"])

        return run_

    content = _content(spark, path)
    head = content.mapInArrow(run(1), "cells array<string>").first()
    columns = headers(head["cells"]) if head else []

    def body(batches):
        first = True
        for batch in run(None)(batches):
            yield batch.slice(1) if first else batch
            first = False

    cells = content.coalesce(1).mapInArrow(body, "cells array<string>")
    return cells.select(*[F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(columns)])


def _letters(k: int) -> str:
    out, k = "", k + 1
    while k:
        k, rest = divmod(k - 1, 26)
        out = chr(65 + rest) + out
    return out


_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _plain(v):
    """A cell's value: numbers and truth values as they are, all else as text; no number and null as none."""
    if v is None or isinstance(v, float) and not math.isfinite(v):
        return None
    if isinstance(v, (bool, int, float)):
        return v
    if isinstance(v, (list, dict)):
        return json.dumps(v, default=str, ensure_ascii=False)
    return _ILLEGAL.sub("", str(v))[:MAX_CHARS]


def _cell(v, ref: str) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(v, {chr(13): "&#13;"})}</t></is></c>'


class _Sink:
    """A file that can only be written on, over a stream of Spark's file system."""

    def __init__(self, stream, size: int = 1 << 20):
        self.stream, self.size, self.held = stream, size, bytearray()

    def write(self, data) -> int:
        self.held += data
        if len(self.held) >= self.size:
            self.flush()
        return len(data)

    def flush(self) -> None:
        if self.held:
            self.stream.write(bytes(self.held))
            self.held = bytearray()


# Names and types that the format demands.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def _sheet(columns: list[str], table: Iterator[list]) -> Iterator[str]:
    """The XML of a sheet: frozen header, filter, and columns as wide as their first 200 cells, within 10 and 45."""
    start = list(itertools.islice(table, 199))
    widths = [min(max(max(len(str(v)) for v in [c, *(r[k] for r in start if r[k] is not None)]) + 2, 10), 45) for k, c in enumerate(columns)]
    yield f'{_XML}<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    if columns:
        yield "<cols>" + "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(widths, 1)) + "</cols>"
    yield "<sheetData>"
    letters, n = [_letters(k) for k in range(len(columns))], 0
    for n, row in enumerate(itertools.chain([columns], start, table), 1):
        if n > MAX_ROWS:
            raise ValueError(f"a sheet holds at most {MAX_ROWS} rows")
        yield f'<row r="{n}">' + "".join(_cell(v, f"{c}{n}") for c, v in zip(letters, row, strict=True)) + "</row>"
    yield "</sheetData>" + (f'<autoFilter ref="A1:{letters[-1]}{n}"/>' if columns else "") + "</worksheet>"


def write(tables: dict[str, DataFrame], path: str) -> None:
    """Tables as the sheets of one file, in order; the file appears when it is whole.

    Rows pass the driver one partition at a time. A table beyond the format's rows or columns raises, as does a name it
    doesn't allow; a text beyond 32,767 characters is cut there, as the format demands. Dates and nested values are texts.
    """
    for name, df in tables.items():
        if not name or len(name) > MAX_NAME or re.search(r"[\[\]:*?/\\]", name) or len(df.columns) > MAX_COLUMNS:
            raise ValueError(f"no sheet can be made of {name}")
    spark = next(iter(tables.values())).sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    to, part = hadoop(path), hadoop(f"{path}.part")
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    numbered = list(enumerate(tables.items(), 1))
    stream = fs.create(part, True)
    try:
        sink = _Sink(stream)
        with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
            kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for k, _ in numbered)
            z.writestr(
                "[Content_Types].xml",
                f'{_XML}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>{kinds}</Types>',
            )
            z.writestr("_rels/.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            sheets = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, (name, _) in numbered)
            z.writestr("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_RELATIONS}"><sheets>{sheets}</sheets></workbook>')
            links = "".join(f'<Relationship Id="rId{k}" Type="{_RELATIONS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k, _ in numbered)
            z.writestr("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
            for k, (_, df) in numbered:
                with z.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as f:
                    for text in _sheet([_plain(c) for c in df.columns], ([_plain(v) for v in r] for r in df.toLocalIterator())):
                        f.write(text.encode())
        sink.flush()
    except BaseException:
        stream.close()
        fs.delete(part, False)
        raise
    stream.close()
    fs.delete(to, False)
    if not fs.rename(part, to):
        raise OSError(f"{path} can't be written")
