"""Workbooks: what is written can be read, and files as other programs write them."""

import datetime as dt
import io
import zipfile

import pytest

from weftline.sources import bundle, workbook

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def foreign(cells: str, since_1904: bool = False) -> bytes:
    """A workbook with shared texts, styles and an absolute target."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><workbookPr date1904="{int(since_1904)}"/><sheets><sheet name="One" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId7" Target="/xl/worksheets/a.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t> Name </t></si><si><r><t>Oak</t></r><r><t xml:space="preserve"> Co</t></r><rPh><t>no</t></rPh></si><si/></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_foreign_file(spark, tmp_path):
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c t="inlineStr"><is><t>name</t></is></c><c r="D1" t="str"><v>Day</v></c></row>'
    body = '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3" t="b"><v>1</v></c><c r="D3" s="1"><v>45293</v></c><c r="E3"><v>9</v></c></row><row r="4"/><row r="5"><c t="e"><v>#N/A</v></c><c s="3"><v>2.5</v></c></row>'
    (tmp_path / "f.xlsx").write_bytes(foreign(head + body))
    df = bundle.read(spark, str(tmp_path / "f.xlsx"))
    assert df.columns == ["Name", "name.1", "Unnamed: 2", "Day"]
    assert [tuple(r) for r in df.collect()] == [("Oak Co", None, "true", "2024-01-02"), (None, "2.5", None, None)]
    assert bundle.table(spark, str(tmp_path / "f.xlsx"), "One").count() == 2 and bundle.names(spark, str(tmp_path / "f.xlsx")) == [("One", "xlsx")]
    with pytest.raises(KeyError):
        list(workbook.rows(foreign(head), "Two"))
    assert list(workbook.rows(foreign(""))) == []
    (tmp_path / "e.xlsx").write_bytes(foreign(""))
    assert workbook.read(spark, str(tmp_path / "e.xlsx")).columns == []


@pytest.mark.parametrize(("serial", "old", "want"), [(1, False, "1900-01-01"), (59, False, "1900-02-28"), (61, False, "1900-03-01"), (45293.5, False, "2024-01-02 12:00:00"), (0.25, False, "06:00:00"), (0, True, "1904-01-01")])
def test_moments(serial, old, want):
    assert workbook.moment(serial, old) == want


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    values = [(1, 'a<&>"\r\nb', 1.5, True, dt.date(2024, 1, 2), [1, 2]), (None, "=1+1", float("nan"), None, None, None), (3, " x\x01 ", -2e300, False, None, [])]
    data = spark.createDataFrame(values, "n long, v string, x double, f boolean, d date, l array<int>")
    bundle.write_workbook({"README": data.select("n").limit(1), "Rows": data}, path)
    assert [n for n, _ in bundle.names(spark, path)] == ["README", "Rows"] and not (tmp_path / "w.xlsx.part").exists()
    got = bundle.table(spark, path)  # the first that is neither a summary nor a readme
    assert got.columns == data.columns
    assert [tuple(r) for r in got.collect()] == [("1", 'a<&>"\r\nb', "1.5", "true", "2024-01-02", "[1, 2]"), (None, "'=1+1", None, None, None, None), ("3", " x ", "-2e+300", "false", None, "[]")]
    bundle.write_workbook({"Rows": data.filter("false")}, path)  # in the place of the last
    assert bundle.table(spark, path).count() == 0 and bundle.table(spark, path).columns == data.columns
    texts = ['a<&>"\r\nb', "c\\", 'd\\"e', "f,g", " h "]
    bundle.write_both(spark.createDataFrame([(t, 1) for t in texts], "v string, n int"), str(tmp_path / "both"), ("csv", "xlsx"))
    for kind in ("csv", "xlsx"):
        assert sorted(tuple(r) for r in bundle.read(spark, str(tmp_path / f"both.{kind}")).collect()) == sorted((t, "1") for t in texts)


def test_look_and_bounds(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "w.xlsx")
    df = spark.range(3000).selectExpr("id", "repeat('x', if(id = 5, 60, 20)) AS long", "if(id = 2500, repeat('y', 40), 'y') AS late")
    workbook.write({"a": df}, path)
    with zipfile.ZipFile(path) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert [f'width="{w}"' in sheet for w in (10, 45, 42)] == [True, True, False]
    assert 'state="frozen"' in sheet and '<autoFilter ref="A1:C3001"/>' in sheet
    assert workbook.read(spark, path).selectExpr("sum(CAST(id AS long)) AS s", "count(*) AS n").first() == (3000 * 2999 // 2, 3000)
    assert [workbook._letters(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert [workbook._column(f"{c}7") for c in ("A", "Z", "AA", "ZZ", "AAA")] == [0, 25, 26, 701, 702]
    monkeypatch.setattr(workbook, "MAX_ROWS", 100)
    with pytest.raises(ValueError, match="at most 100 rows"):
        workbook.write({"a": df}, str(tmp_path / "no.xlsx"))
    assert [f.name for f in tmp_path.iterdir() if f.name.startswith(("no.", ".no."))] == []
    for name in ("", "a/b", "x" * 32):
        with pytest.raises(ValueError, match="no sheet"):
            workbook.write({name: df}, path)
