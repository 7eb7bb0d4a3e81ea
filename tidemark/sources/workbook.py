"""Workbooks as a Spark data source: a partition a sheet, rows streamed from its XML.

``spark.read.format("workbook").load(path)`` after ``register(spark)``; the option ``sheet`` names one sheet.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.sliced import located

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class Sheet(InputPartition):
    def __init__(self, name: str, part: str) -> None:
        self.name, self.part = name, part


def column_number(cell: str) -> int:
    """Number (from 0) of the column of a cell such as AB12."""
    at = 0
    for c in re.match(r"[A-Z]+", cell)[0]:
        at = at * 26 + ord(c) - 64
    return at - 1


def _text(node: ElementTree.Element) -> str:
    """Text of a string item: its own and that of its runs, without phonetic hints."""
    own = [t.text or "" for t in node.findall(f"{_SHEET}t")]
    return "".join(own + [t.text or "" for r in node.findall(f"{_SHEET}r") for t in r.findall(f"{_SHEET}t")])


def _items(f, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a name as they end; what has been read is let go."""
    stack = []
    for event, node in ElementTree.iterparse(f, events=("start", "end")):
        if event == "start":
            stack.append(node)
        else:
            stack.pop()
            if node.tag == f"{_SHEET}{tag}":
                yield node
                if stack:
                    stack[-1].remove(node)


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None) -> None:
        self.path, self.sheet = path, sheet

    def _open(self) -> zipfile.ZipFile:
        system, own = located(self.path)
        return zipfile.ZipFile(system.open_input_file(own))

    def partitions(self) -> list[Sheet]:
        with self._open() as book:
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
            sheets = [(s.get("name"), targets[s.get(f"{_REL}id")]) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")]
        found = [Sheet(n, t.removeprefix("/") if t.startswith("/") else f"xl/{t}") for n, t in sheets if self.sheet in (None, n)]
        if self.sheet is not None and not found:
            raise ValueError(f"no sheet {self.sheet} among {[n for n, _ in sheets]}")
        return found

    def read(self, partition: Sheet) -> Iterator[tuple]:
        with self._open() as book:
            strings: list[str] = []
            if "xl/sharedStrings.xml" in book.namelist():
                with book.open("xl/sharedStrings.xml") as f:
                    strings = [_text(s) for s in _items(f, "si")]
            with book.open(partition.part) as f:
                number = 0
                for row in _items(f, "row"):
                    number = int(row.get("r", number + 1))
                    cells: dict[int, str | None] = {}
                    for cell in row.findall(f"{_SHEET}c"):
                        at = column_number(cell.get("r")) if cell.get("r") else max(cells, default=-1) + 1
                        value, inline = cell.find(f"{_SHEET}v"), cell.find(f"{_SHEET}is")
                        text = _text(inline) if inline is not None else None if value is None else value.text
                        cells[at] = strings[int(text)] if cell.get("t") == "s" and text is not None else text
                    yield partition.name, number, [cells.get(i) for i in range(max(cells, default=-1) + 1)]


class WorkbookSource(DataSource):
    """Rows of the sheets of an .xlsx file: sheet, row (its number), cells (as text, null where there is none)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "sheet string, row long, cells array<string>"

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"], self.options.get("sheet"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """A sheet whose first row names the columns (trimmed), all as text; empty rows are none, short rows are filled with nulls."""
    register(spark)
    rows = spark.read.format("workbook").option("sheet", sheet).load(path)
    first = rows.orderBy("row").limit(1).collect()
    if not first:
        raise ValueError(f"sheet {sheet} is empty")
    names = [(i, c.strip()) for i, c in enumerate(first[0].cells) if c is not None and c.strip()]
    body = rows.where((F.col("row") > first[0].row) & F.exists("cells", lambda c: c.isNotNull()))
    return body.select(*(F.get("cells", F.lit(i)).alias(n) for i, n in names))
