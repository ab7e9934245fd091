"""Workbook (.xlsx) scan: one task per group of files, rows streamed out of the sheet in batches."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_BATCH_ROWS = 5_000

# Namespaces of the workbook format.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _texts(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{_MAIN}t"))


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return [_texts(item) for item in root.findall(f"{_MAIN}si")]


def _sheet_path(book: zipfile.ZipFile, sheet: str | None) -> str:
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f".//{_MAIN}sheet")
    chosen = next(s for s in sheets if sheet is None or s.get("name") == sheet)
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(x.get("Target") for x in links if x.get("Id") == chosen.get(f"{_LINK}id"))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _position(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def _cell_text(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return _texts(cell)
    value = cell.find(f"{_MAIN}v")
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    return value.text


def _rows(content: bytes, sheet: str | None) -> Iterator[dict[int, str | None]]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared_strings(book)
        with book.open(_sheet_path(book, sheet)) as data:
            for _, element in ElementTree.iterparse(data):
                if element.tag == f"{_MAIN}row":
                    cells = enumerate(element.findall(f"{_MAIN}c"))
                    yield {
                        _position(c.get("r")) if c.get("r") else i: _cell_text(c, shared)
                        for i, c in cells
                    }
                    element.clear()


def _reader(columns: Sequence[str], sheet: str | None) -> Callable:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, content in zip(files["path"], files["content"]):
                rows = _rows(content, sheet)
                header = {name: at for at, name in next(rows, {}).items()}
                places = [header.get(c) for c in columns]
                batch: list[list[str | None]] = []
                for row in rows:
                    if not row:
                        continue
                    batch.append([path, *(row.get(at) for at in places)])
                    if len(batch) == _BATCH_ROWS:
                        yield pd.DataFrame(batch, columns=["source_path", *columns], dtype="object")
                        batch = []
                if batch:
                    yield pd.DataFrame(batch, columns=["source_path", *columns], dtype="object")

    return read


def read_workbooks(
    spark: SparkSession, path: str, columns: Sequence[str], sheet: str | None = None
) -> DataFrame:
    """First (or named) sheet of every workbook below ``path``: first row is the header, all text.

    ``columns`` are the wanted headers as they stand in the files. A workbook without one of them
    gives nulls, so files of different shape can lie in one folder.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.xlsx")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "content")
    )
    schema = ", ".join(f"`{c}` string" for c in ["source_path", *columns])
    return files.mapInPandas(_reader(list(columns), sheet), schema)
