"""Spreadsheets (``.xlsx``) as a source and sink of Spark, streamed row by row.

``register(spark)`` makes ``spark.read.format("sheets")`` and ``df.write.format("sheets")`` known. A workbook is read in ranges of rows,
a task for each; a task streams its sheet and keeps one row at a time and the workbook's shared strings. The writer makes a
workbook of each partition, more where it has more rows than a sheet holds; only those of tasks that Spark counted get their names.
"""

from __future__ import annotations

import datetime as dt
import glob
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from xml.etree.ElementTree import Element, iterparse
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Limits and names of the file format.
MAX_ROWS, MAX_TEXT = 1 << 20, 32767
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                           f'<Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_KIND}.styles+xml"/>'
                           f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_KIND}.worksheet+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/>'
                                  f'<Relationship Id="r2" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
                     '<cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
}
_DAY = dt.timedelta(days=1)
_EPOCH, _EPOCH_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)


def register(spark: SparkSession) -> None:
    """Make the format ``sheets`` known to a session."""
    spark.dataSource.register(Sheets)


class Sheets(DataSource):
    """Options: ``path`` (a workbook, a folder of them or a pattern), ``sheet`` (a name; the first one by default), ``range_rows`` (65,536).

    The first row of a sheet names its columns. With a schema, columns are found by name, and one that the sheet lacks is NULL; without
    it all are texts, those of the first workbook. Empty cells, errors and empty rows between others are NULL values and no rows.
    A cell that doesn't fit its column's type ends the query with an error. Written numbers keep all digits, floats are exact;
    times are those of the writing session's zone, to the microsecond; texts above 32,767 characters are an error, as in the format.
    """

    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> T.StructType:
        first = _workbooks(self.options["path"])[0]
        with zipfile.ZipFile(first) as book:
            _, names = _header(book, _place(book, self.options.get("sheet"))[0], _shared(book))
        return T.StructType([T.StructField(x, T.StringType()) for x in names if x is not None])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SheetReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return SheetWriter(schema, dict(self.options), overwrite)


def _workbooks(path: str) -> list[str]:
    """All workbooks that a path names, by name; hidden ones and those of an unfinished write are none."""
    path = path.removeprefix("file:")
    found = glob.glob(f"{glob.escape(path)}/*.xlsx") if os.path.isdir(path) else [path] if os.path.isfile(path) else glob.glob(path)
    found = sorted(x for x in found if not os.path.basename(x).startswith((".", "_", "~$")))
    if not found:
        raise FileNotFoundError(f"no workbook at {path}")
    return found


def _elements(book: zipfile.ZipFile, part: str, name: str) -> Iterator[Element]:
    """The elements of a name in a part of a workbook, one after another, each forgotten behind it."""
    with book.open(part) as stream:
        above: list[Element] = []
        for event, x in iterparse(stream, ("start", "end")):
            if event == "start":
                above.append(x)
                continue
            above.pop()
            if x.tag.rpartition("}")[2] == name:
                yield x
                if above:
                    above[-1].clear()


def _place(book: zipfile.ZipFile, sheet: str | None) -> tuple[str, bool]:
    """The part that holds a sheet, and whether its days count from 1904."""
    old = any(x.get("date1904") in ("1", "true") for x in _elements(book, "xl/workbook.xml", "workbookPr"))
    for x in _elements(book, "xl/workbook.xml", "sheet"):
        if sheet is None or x.get("name") == sheet:
            wanted = x.get(f"{{{_REL}}}id")
            target = next(r.get("Target") for r in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship") if r.get("Id") == wanted)
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}", old
    raise ValueError(f"no sheet {sheet!r}")


def _text(x: Element) -> str:
    """The text of a string item, without its phonetic reading."""
    heard = {t for r in x.iter() if r.tag.endswith("}rPh") for t in r.iter()}
    return _unescaped("".join(t.text or "" for t in x.iter() if t.tag.endswith("}t") and t not in heard))


def _unescaped(text: str) -> str:
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _escaped(text: str) -> str:
    """Characters that XML can't hold, or would change, in the format's own way; so is what looks like that."""
    text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    return escape(re.sub(r"[\x00-\x08\x0b-\x1f\ufffe\uffff]", lambda m: f"_x{ord(m[0]):04X}_", text))


def _shared(book: zipfile.ZipFile) -> list[str]:
    return [_text(x) for x in _elements(book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in book.namelist() else []


def _column(reference: str) -> int:
    out = 0
    for c in reference.rstrip("0123456789"):
        out = out * 26 + ord(c) - 64
    return out - 1


def _rows(book: zipfile.ZipFile, part: str, shared: list[str], start: int, stop: int | None) -> Iterator[tuple[int, dict[int, tuple[str, str]]]]:
    """``(number, {column: (kind, text)})`` of the rows numbered ``start`` to before ``stop`` that have values."""
    number = 0
    for row in _elements(book, part, "row"):
        number = int(row.get("r", number + 1))
        if stop is not None and number >= stop:
            return
        if number < start:
            continue
        cells, at = {}, -1
        for c in row:
            at = _column(c.get("r")) if c.get("r") else at + 1
            kind = c.get("t", "n")
            v = next((x.text for x in c if x.tag.endswith("}v")), None)
            if kind == "inlineStr":
                cells[at] = ("str", "".join(_text(x) for x in c if x.tag.endswith("}is")))
            elif v is not None and kind != "e":
                cells[at] = ("str", shared[int(v)]) if kind == "s" else (kind, _unescaped(v) if kind == "str" else v)
        if cells:
            yield number, cells


def _header(book: zipfile.ZipFile, part: str, shared: list[str]) -> tuple[int, list[str | None]]:
    """The number of the first row that has values, and the names in it by place."""
    number, first = next(_rows(book, part, shared, 1, None), (0, {}))
    return number, [first[i][1] if i in first else None for i in range(max(first, default=-1) + 1)]


@dataclass
class RowRange(InputPartition):
    """Rows of a sheet, the header not counted; the last range of a sheet has no end, as sheets may misstate their size."""

    path: str
    start: int
    stop: int | None


class SheetReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def partitions(self) -> list[RowRange]:
        step, out = int(self.options.get("range_rows", 1 << 16)), []
        for path in _workbooks(self.options["path"]):
            with zipfile.ZipFile(path) as book:
                part, _ = _place(book, self.options.get("sheet"))
                with book.open(part) as stream:
                    stated = re.search(rb'<dimension ref="[A-Z]+\d+:[A-Z]+(\d+)"', stream.read(4096))
            last = min(int(stated[1]), MAX_ROWS) if stated else 0
            starts = list(range(1, max(last, 1) + 1, step))
            out += [RowRange(path, a, b) for a, b in zip(starts, [*starts[1:], None])]
        return out

    def read(self, partition: RowRange) -> Iterator[tuple]:
        with zipfile.ZipFile(partition.path) as book:
            part, old = _place(book, self.options.get("sheet"))
            shared = _shared(book)
            head, names = _header(book, part, shared)
            at = [names.index(f.name) if f.name in names else None for f in self.schema.fields]
            for _, cells in _rows(book, part, shared, max(partition.start, head + 1), partition.stop):
                yield tuple(_value(cells.get(i), f.dataType, old) for i, f in zip(at, self.schema.fields))


def _value(cell: tuple[str, str] | None, kind: T.DataType, old: bool):
    """A cell as a value of its column's type."""
    if cell is None:
        return None
    what, text = cell
    if isinstance(kind, T.StringType):
        return {"1": "true", "0": "false"}[text] if what == "b" else text
    if isinstance(kind, T.BooleanType):
        return {"1": True, "0": False, "true": True, "false": False}[text.lower()]
    if isinstance(kind, T.IntegralType):
        return int(Decimal(text))
    if isinstance(kind, T.DecimalType):
        return Decimal(text)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float(text)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if what == "n":
            time = (_EPOCH_1904 if old else _EPOCH) + dt.timedelta(microseconds=int((Decimal(text) * 86_400_000_000).to_integral_value()))
        else:
            time = dt.datetime.fromisoformat(text)
        return time.date() if isinstance(kind, T.DateType) else time
    raise ValueError(f"cells can't be of type {kind.simpleString()}")


def _cell(value: object) -> str:
    """The XML of a cell without its reference: cells follow each other, so an empty one keeps its place."""
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float, Decimal)):
        if isinstance(value, float) and (value != value or abs(value) == float("inf")):
            return f'<c t="str"><v>{value}</v></c>'  # the format has no such number
        return f"<c><v>{value!r}</v></c>" if isinstance(value, float) else f"<c><v>{value}</v></c>"
    if isinstance(value, (dt.date, dt.datetime)):
        whole = isinstance(value, dt.datetime)
        time = value.replace(tzinfo=None) if whole else dt.datetime(value.year, value.month, value.day)
        days = Decimal((time - _EPOCH) // dt.timedelta(microseconds=1)) / 86_400_000_000
        return f'<c s="{2 if whole else 1}"><v>{days:f}</v></c>'
    if not isinstance(value, str):
        raise ValueError(f"a cell can't hold {type(value).__name__}")
    if len(value.encode("utf-16-le")) // 2 > MAX_TEXT:
        raise ValueError(f"a text of more than {MAX_TEXT} characters")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{_escaped(value)}</t></is></c>'


@dataclass
class Written(WriterCommitMessage):
    """The hidden names of a task's workbooks."""

    paths: list[str]


class SheetWriter(DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool):
        self.schema, self.options, self.overwrite = schema, options, overwrite
        self.path = options["path"].removeprefix("file:")

    def write(self, iterator: Iterator[T.Row]) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        context, rows, paths = TaskContext.get(), iter(iterator), []
        row = next(rows, None)
        while row is not None or (not paths and context.partitionId() == 0):  # an empty table is a workbook with a header alone
            path = f"{self.path}/.part-{context.partitionId():05d}-{len(paths):03d}-{uuid.uuid4().hex}.xlsx"
            row = self._workbook(path, row, rows)
            paths.append(path)
        return Written(paths)

    def _workbook(self, path: str, row: T.Row | None, rows: Iterator[T.Row]) -> T.Row | None:
        """One workbook, as many rows as a sheet holds; the first row of the next one."""
        name = quoteattr(self.options.get("sheet", "Sheet1"))
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as book:
            for part, xml in _PARTS.items():
                book.writestr(part, _HEAD + xml)
            book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name={name} sheetId="1" r:id="r1"/></sheets></workbook>')
            with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
                def put(values) -> None:
                    out.write(f"<row>{''.join(map(_cell, values))}</row>\n".encode())

                out.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                put(self.schema.names)
                for _ in range(MAX_ROWS - 1):
                    if row is None:
                        break
                    put(row)
                    row = next(rows, None)
                out.write(b"</sheetData></worksheet>")
        return row

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            for old in glob.glob(f"{glob.escape(self.path)}/*.xlsx"):
                os.remove(old)
        for path in (p for m in messages if m for p in m.paths):
            os.replace(path, f"{self.path}/{os.path.basename(path)[1:]}")

    def abort(self, messages: list[Written | None]) -> None:
        for path in (p for m in messages if m for p in m.paths):
            if os.path.exists(path):
                os.remove(path)
