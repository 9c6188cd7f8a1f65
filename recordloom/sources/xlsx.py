"""Spreadsheets as a Spark data source: the first sheet of an .xlsx file as (row_no, cells).

    spark.dataSource.register(XlsxSource); spark.read.format("xlsx_rows").load(path)

A workbook is one zip archive, so one file is one partition; several paths, comma-separated, are read in
parallel.  Cells are text; blanks are empty; rows may differ in length.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator
from itertools import chain
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ET.fromstring(book.read("xl/workbook.xml")).find(f"{_NS}sheets/{_NS}sheet")
    if sheet is None:
        raise ValueError("the workbook has no sheet")
    rels = ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels if r.get("Id") == sheet.get(f"{_RELS}id"))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def read_rows(path: str) -> Iterator[tuple[int, list[str]]]:
    with zipfile.ZipFile(path) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml"))]
        with book.open(_first_sheet(book)) as sheet:
            number = 0
            for _, row in ET.iterparse(sheet):
                if row.tag != f"{_NS}row":
                    continue
                number = int(row.get("r") or number + 1)
                cells: list[str] = []
                for c in row.iter(f"{_NS}c"):
                    at = _column(c.get("r") or "") if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    value = c.find(f"{_NS}v")
                    kind = c.get("t")
                    if kind == "s" and value is not None:
                        cells[at] = shared[int(value.text)]
                    elif kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    elif value is not None:
                        cells[at] = value.text or ""
                yield number - 1, cells
                row.clear()


def write_rows(path: str, rows: Iterable[list[str]], sheet: str = "Sheet1") -> None:
    """A plain workbook of text cells, written row by row, for exports of a size that a spreadsheet can hold."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main, rels, types = _NS[1:-1], _RELS[1:-1], "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{types}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{types}/relationships"><Relationship Id="rId1" Type="{rels}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rels}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{types}/relationships"><Relationship Id="rId1" Type="{rels}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with book.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
            for i, row in enumerate(rows, 1):
                cells = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for v in row)
                out.write(f'<row r="{i}">{cells}</row>'.encode())
            out.write(b"</sheetData></worksheet>")


#: Rows that a sheet can hold.
SHEET_ROWS = 1 << 20


def export(df: DataFrame, path: str) -> None:
    """Write a small result as a workbook, one partition of it on the driver at a time; results larger than a sheet go to Parquet or CSV by Spark's own writers."""
    if df.limit(SHEET_ROWS).count() >= SHEET_ROWS:
        raise ValueError("more rows than a sheet can hold")
    body = (["" if v is None else str(v) for v in row] for row in df.toLocalIterator())
    write_rows(path, chain([df.columns], body))


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_rows"

    def schema(self) -> str:
        return "path string, row_no int, cells array<string>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options["path"].split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for number, cells in read_rows(partition.value):
            yield partition.value, number, cells
