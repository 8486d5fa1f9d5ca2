"""Workbooks (xlsx) as a data source: a sheet's cells as they stand, read on executors as a stream.

A workbook is a zip of XML. Its sheet is parsed row by row, its shared strings are kept as bytes with their offsets, so
that a task holds neither the sheet nor an object for each string. A folder of workbooks is read by as many tasks.
"""

from __future__ import annotations

import posixpath
import re
import zipfile
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from .trees import TreeReader, located

FORMAT = "workbook"
ROWS = 1000
#: The namespaces' local names are all that counts here.
_LOCAL = re.compile(r"^\{[^}]*\}")
_CELL = re.compile(r"([A-Z]+)[0-9]+")
_ESCAPE = re.compile(r"_x([0-9A-Fa-f]{4})_")


def _events(stream, *wanted: str) -> Iterator[tuple[str, ElementTree.Element]]:  # noqa: ANN001
    """Local name and element of each wanted element that ends; what has been read is dropped."""
    parents: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            parents.append(element)
            continue
        parents.pop()
        name = _LOCAL.sub("", element.tag)
        if name in wanted:
            yield name, element
            element.clear()
            if parents:
                parents[-1].remove(element)


def _text(element: ElementTree.Element) -> str:
    """The text of a string item: its runs joined, phonetic hints left out."""
    parts = []

    def walk(e: ElementTree.Element) -> None:
        for child in e:
            name = _LOCAL.sub("", child.tag)
            if name == "t":
                parts.append(child.text or "")
            elif name != "rPh":
                walk(child)

    walk(element)
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


class SharedStrings:
    """A workbook's strings as one run of bytes and the places where each ends."""

    def __init__(self) -> None:
        self.held, self.ends = bytearray(), array("Q")

    def add(self, text: str) -> None:
        self.held += text.encode("utf-8", "surrogatepass")
        self.ends.append(len(self.held))

    def __getitem__(self, i: int) -> str:
        return self.held[self.ends[i - 1] if i else 0 : self.ends[i]].decode("utf-8", "replace")


@contextmanager
def _opened(path: str) -> Iterator[zipfile.ZipFile]:
    system, at = located(path)
    with system.open_input_file(at) as file, zipfile.ZipFile(file) as archive:
        yield archive


def _sheet_part(archive: zipfile.ZipFile, sheet: str | None) -> str:
    """The part that holds a sheet: the one of that name, or the first."""
    with archive.open("xl/workbook.xml") as stream:
        sheets = [dict(e.attrib) for _, e in _events(stream, "sheet")]
    found = next((s for s in sheets if sheet is None or s["name"] == sheet), None)
    if found is None:
        raise ValueError(f"no sheet {sheet!r}")
    key = next(v for k, v in found.items() if _LOCAL.sub("", k) == "id" and k != "id")
    with archive.open("xl/_rels/workbook.xml.rels") as stream:
        target = next(e.attrib["Target"] for _, e in _events(stream, "Relationship") if e.attrib["Id"] == key)
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")


def column_number(reference: str) -> int:
    """The number from 0 of a cell's column: A1 is in column 0, AA1 in 26."""
    n = 0
    for c in _CELL.match(reference)[1]:
        n = 26 * n + ord(c) - 64
    return n - 1


def rows(path: str, sheet: str | None = None) -> Iterator[dict[int, str]]:
    """The cells of each row that has some, by column, as they stand in the file: numbers as they are written, truth as 1 and 0."""
    with _opened(path) as archive:
        part, strings = _sheet_part(archive, sheet), SharedStrings()
        if "xl/sharedStrings.xml" in archive.namelist():
            with archive.open("xl/sharedStrings.xml") as stream:
                for _, item in _events(stream, "si"):
                    strings.add(_text(item))
        with archive.open(part) as stream:
            cells: dict[int, str] = {}
            at = 0
            for name, e in _events(stream, "c", "row"):
                if name == "row":
                    if cells:
                        yield cells
                    cells, at = {}, 0
                    continue
                at = column_number(e.attrib["r"]) if "r" in e.attrib else at
                kind = e.attrib.get("t", "n")
                value = next((c for c in e if _LOCAL.sub("", c.tag) == ("is" if kind == "inlineStr" else "v")), None)
                if value is not None:
                    text = _text(value) if kind == "inlineStr" else strings[int(value.text)] if kind == "s" else value.text
                    if text and kind != "e":
                        cells[at] = text
                at += 1


def header(path: str, sheet: str | None = None) -> dict[int, str]:
    """Column -> name, from the first row that has cells, which is all that is read of the sheet. A name that comes again gets a number."""
    seen: dict[str, int] = {}
    out = {}
    for at, name in sorted(next(rows(path, sheet), {}).items()):
        seen[name] = seen.get(name, -1) + 1
        out[at] = f"{name}.{seen[name]}" if seen[name] else name
    return out


@dataclass
class Book(InputPartition):
    path: str


class WorkbookReader(DataSourceReader):
    """A task for each workbook; its columns go by their names in its own header."""

    def __init__(self, paths: list[str], sheet: str | None, names: list[str]) -> None:
        self.paths, self.sheet, self.names = paths, sheet, names

    def partitions(self) -> list[Book]:
        return [Book(p) for p in self.paths]

    def read(self, partition: Book) -> Iterator[pa.RecordBatch]:
        found = rows(partition.path, self.sheet)
        own = {name: at for at, name in header(partition.path, self.sheet).items()}
        next(found, None)
        columns = [own.get(n) for n in self.names]
        held: list[dict] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in held], pa.string()) for c in columns], self.names)

        for row in found:
            held.append(row)
            if len(held) == ROWS:
                yield batch()
                held.clear()
        if held:
            yield batch()


class Workbooks(DataSource):
    """workbook. Reading: path of a workbook or of a folder of them, sheet (the first one unless given)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _paths(self) -> list[str]:
        found = TreeReader({"path": self.options["path"], "glob": "*.xls[xm]"}).listed()
        if not found:
            raise FileNotFoundError(self.options["path"])
        return [path for path, _, _ in found]

    def schema(self) -> StructType:
        return StructType([StructField(n, StringType()) for n in header(self._paths()[0], self.options.get("sheet")).values()])

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self._paths(), self.options.get("sheet"), schema.names)


def read(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet's rows below its header, all strings, empty cells null; of a folder, those of all its workbooks by the first one's header."""
    spark.dataSource.register(Workbooks)
    options = {"path": path} | ({"sheet": sheet} if sheet else {})
    return spark.read.format(FORMAT).options(**options).load()
