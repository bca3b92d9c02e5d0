"""Workbooks: round trips of values of all types, ranges of rows, and workbooks as other programs write them."""

import datetime as dt
import zipfile
from decimal import Decimal

import pytest

from weftline.sources import sheets

SCHEMA = "id long, s string, b boolean, f double, n decimal(30,5), d date, t timestamp_ntz"


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    sheets.register(spark)


def some(i):
    texts = [None, "", " a ", "<&>\"'", "_x0041_", "a\rb\n\tc\x01", "ü𝄞", "1"]
    return (i if i != 3 else 2**62 + 1, texts[i % 8], None if i % 5 == 0 else i % 2 == 0, [0.1, -1e300, None, 3.0][i % 4], None if i % 3 == 0 else Decimal(i) / 7 // Decimal("0.00001") * Decimal("0.00001"),
            None if i % 7 == 0 else dt.date(1950, 1, 1) + dt.timedelta(days=i * 37), dt.datetime(2024, 2, 28, 23, 59, 59, 999999) + dt.timedelta(seconds=i * 9973))


def test_round_trip(spark, tmp_path, monkeypatch):
    rows = [some(i) for i in range(200)]
    path = str(tmp_path / "book")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.format("sheets").mode("append").save(path)
    read = spark.read.format("sheets").schema(SCHEMA)
    assert sorted(map(tuple, read.load(path).collect())) == sorted(rows)
    assert spark.read.format("sheets").load(path).columns == ["id", "s", "b", "f", "n", "d", "t"]
    spark.createDataFrame(rows[:5], SCHEMA).coalesce(1).write.format("sheets").mode("overwrite").save(path)
    assert sorted(map(tuple, read.load(path).collect())) == sorted(rows[:5])
    spark.createDataFrame([], SCHEMA).write.format("sheets").mode("overwrite").save(path)
    assert read.load(path).collect() == [] and spark.read.format("sheets").load(path).collect() == []
    with pytest.raises(Exception, match="32767"):
        spark.range(1).selectExpr("repeat('x', 40000) as s").write.format("sheets").mode("append").save(path)


def foreign(path, rows, dimension):
    """A workbook with shared strings, two sheets, gaps between cells and rows, and errors."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><workbookPr date1904="1"/><sheets><sheet name="other" sheetId="1" r:id="a"/><sheet name="data" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/one.xml"/><Relationship Id="b" Target="/xl/worksheets/two.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r><rPh><t>x</t></rPh></si><si><t>when</t></si></sst>")
        z.writestr("xl/worksheets/one.xml", f'<worksheet {ns}><sheetData/></worksheet>')
        body = "".join(f'<row r="{i * 2 + 5}"><c r="B{i * 2 + 5}"><v>{i}</v></c><c r="AA{i * 2 + 5}" t="str"><v>n{i}</v></c><c r="AB{i * 2 + 5}"><v>{i}.5</v></c></row><row r="{i * 2 + 6}"><c r="B{i * 2 + 6}" s="1"/></row>' for i in range(rows))
        z.writestr("xl/worksheets/two.xml", f'<worksheet {ns}>{dimension}<sheetData><row r="2"/><row r="3"><c r="B3" t="s"><v>0</v></c><c r="AA3" t="s"><v>1</v></c><c r="AB3" t="s"><v>2</v></c></row>'
                                            f'<row r="4"><c r="B4" t="e"><v>#N/A</v></c><c r="AA4" t="inlineStr"><is><t>err</t></is></c></row>{body}</sheetData></worksheet>')


@pytest.mark.parametrize("dimension", ["", '<dimension ref="B3:AB40"/>', '<dimension ref="B3:AB2000"/>'])
def test_workbooks_of_others(spark, tmp_path, dimension):
    foreign(tmp_path / "x.xlsx", 50, dimension)
    df = spark.read.format("sheets").schema("when timestamp_ntz, id int, name string, absent int").option("sheet", "data").option("range_rows", 7).load(str(tmp_path / "x.xlsx"))
    want = [(None, None, "err", None)] + [(dt.datetime(1904, 1, 1, 12) + dt.timedelta(days=i), i, f"n{i}", None) for i in range(50)]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert df.rdd.getNumPartitions() >= (1 if not dimension else 5)
    assert spark.read.format("sheets").load(str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="no sheet"):
        spark.read.format("sheets").option("sheet", "none").load(str(tmp_path / "x.xlsx")).collect()
