"""Spreadsheets as frames: a task for each workbook, read through Spark's own file access and taken apart row by row."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
CELLS_DDL = "file string, sheet_number int, sheet string, row long, cells array<string>"
CELLS = pa.schema([("file", pa.string()), ("sheet_number", pa.int32()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string()))])


def _text(node: ElementTree.Element) -> str:
    """The text of a string item, without what spells out its pronunciation."""
    return "".join(t.text or "" for part in node for t in ([part] if part.tag == MAIN + "t" else part.findall(MAIN + "t") if part.tag == MAIN + "r" else []))


def _shows_date(code: str) -> bool:
    return bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]', "", code.lower())))


def _column(reference: str) -> int:
    """The place, from 0 on, of a cell such as AB12 in its row."""
    at = 0
    for c in reference:
        if not c.isalpha():
            break
        at = at * 26 + ord(c.upper()) - 64
    return at - 1


class Workbook:
    """The sheets of a workbook's bytes."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.zip.namelist())
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        place = lambda t: t.lstrip("/") if t.startswith("/") else "xl/" + t
        self.sheets = [(s.get("name"), place(targets[s.get(RELATION)])) for s in book.iter(MAIN + "sheet")]
        settings = book.find(MAIN + "workbookPr")
        self.epoch = datetime(1904, 1, 1) if settings is not None and settings.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        self.strings = [_text(x) for x in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml")).findall(MAIN + "si")] if "xl/sharedStrings.xml" in names else []
        self.dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
            shown = DATE_FORMATS | {int(f.get("numFmtId")) for f in styles.iter(MAIN + "numFmt") if _shows_date(f.get("formatCode", ""))}
            formats = styles.find(MAIN + "cellXfs")
            self.dates = {i for i, f in enumerate(formats if formats is not None else []) if int(f.get("numFmtId", 0)) in shown}

    def _value(self, cell: ElementTree.Element) -> str | None:
        kind, value = cell.get("t", "n"), cell.find(MAIN + "v")
        if kind == "inlineStr":
            inside = cell.find(MAIN + "is")
            return None if inside is None else _text(inside)
        if value is None or value.text is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(value.text)]
        if kind == "b":
            return "true" if value.text == "1" else "false"
        if kind == "n" and int(cell.get("s", 0)) in self.dates:
            at = self.epoch + timedelta(microseconds=round(float(value.text) * 86_400_000_000))
            return at.isoformat(sep=" ")
        return value.text

    def rows(self, path: str) -> Iterator[tuple[int, list[str | None]]]:
        """Number, from 1 on, and cells of each row of a sheet that has any; a row at a time is held."""
        number = 0
        with self.zip.open(path) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != MAIN + "row":
                    continue
                number = int(node.get("r", number + 1))
                cells: list[str | None] = []
                for cell in node.findall(MAIN + "c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells)) + [self._value(cell)]
                node.clear()
                if any(c is not None for c in cells):
                    yield number, cells


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet_number (from 0), sheet, row (from 1) and cells, as text, of every row that is not empty of all sheets of all workbooks at path.

    Shared and rich strings are resolved, dates become timestamps in text, errors and empty cells null. Workbooks are
    read by Spark, from whatever store it reads; one is a task's, which their own limit of rows bounds.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(*(c.to_pylist() for c in batch.columns)):
                book = Workbook(content)
                for number, (name, place) in enumerate(book.sheets):
                    held: list[tuple] = []
                    for row, cells in book.rows(place):
                        held.append((file, number, name, row, cells))
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), CELLS)], schema=CELLS)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), CELLS)], schema=CELLS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInArrow(run, CELLS_DDL)


def read_xlsx(spark: SparkSession, path: str, sheet: int | str = 0, skip: int = 0) -> DataFrame:
    """A sheet of the workbooks at path as a frame of text columns, named by its first row after `skip` rows.

    Files must agree on the header, else ValueError. Columns without a name are left out, of equal names the first is
    kept; cells beyond the header are not read, missing ones are null.
    """
    cells = read_cells(spark, path).filter(F.col("sheet_number") == sheet if isinstance(sheet, int) else F.col("sheet") == sheet).filter(F.col("row") > skip)
    heads = [tuple(r["cells"]) for r in cells.groupBy("file").agg(F.min_by("cells", "row").alias("cells")).select("cells").distinct().limit(2).collect()]
    if len(heads) != 1:
        raise ValueError("the files' headers differ" if heads else f"no rows in sheet {sheet!r} of {path}")
    first = cells.groupBy("file").agg(F.min("row").alias("_head"))
    names: dict[str, int] = {}
    for i, name in enumerate(heads[0]):
        if name and name.strip():
            names.setdefault(name.strip(), i)
    body = cells.join(F.broadcast(first), "file").filter(F.col("row") > F.col("_head"))  # a row for each file
    return body.select(*[F.get("cells", F.lit(i)).alias(name) for name, i in names.items()])
