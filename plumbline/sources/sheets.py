"""Tables from spreadsheets (.xlsx): the sheet's XML is read out of the zip by the tasks, never by the driver.

A file is one row of Spark's `binaryFile` source, so any store that Spark reads will do; a sheet holds a million rows at most by
its format, and a task streams through it, holding one row and the shared texts of the workbook.  Text, numbers, truth
values (as 1 and 0) and the results of formulas come through; dates are the numbers that the format keeps for them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import iterparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.storage import kept

#: Rows that a task hands on at once.
ROWS = 1000


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def column_number(reference: str) -> int:
    """0 for A1, 27 for AB7."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _texts(book: zipfile.ZipFile) -> list[str]:
    """The shared texts, each of one run or several."""
    out = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            for _, e in iterparse(f):
                if _local(e.tag) == "si":
                    out.append("".join(t.text or "" for t in e.iter() if _local(t.tag) == "t"))
                    e.clear()
    return out


def _part(book: zipfile.ZipFile, sheet: str | int) -> str:
    """The name of the part with a sheet, by its title or number."""
    with book.open("xl/workbook.xml") as f:
        listed = [(e.get("name"), next(v for k, v in e.attrib.items() if _local(k) == "id")) for _, e in iterparse(f) if _local(e.tag) == "sheet"]
    with book.open("xl/_rels/workbook.xml.rels") as f:
        targets = {e.get("Id"): e.get("Target") for _, e in iterparse(f) if _local(e.tag) == "Relationship"}
    found = [i for k, (name, i) in enumerate(listed) if sheet in (name, k)]
    if not found:
        raise ValueError(f"no sheet {sheet!r}; there are {[n for n, _ in listed]}")
    target = targets[found[0]]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def rows_of(content: bytes, sheet: str | int = 0) -> Iterator[list[str | None]]:
    """The rows of a sheet as texts, empty cells as None, rows without any cell left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        texts = _texts(book)
        with book.open(_part(book, sheet)) as f:
            for _, e in iterparse(f):
                if _local(e.tag) != "row":
                    continue
                row: dict[int, str] = {}
                for at, c in enumerate(e):
                    kind, value = c.get("t"), next((x.text for x in c if _local(x.tag) == "v"), None)
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                    elif kind == "s" and value is not None:
                        value = texts[int(value)]
                    elif kind == "e":
                        value = None
                    if value not in (None, ""):
                        row[column_number(c.get("r")) if c.get("r") else at] = value
                if row:
                    yield [row.get(k) for k in range(max(row) + 1)]
                e.clear()


def _parsed(sheet: str | int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                lot: list[list[str | None]] = []
                n = 0
                for row in rows_of(content, sheet):
                    lot.append(row)
                    if len(lot) == ROWS:
                        yield _batch(n, lot)
                        n, lot = n + len(lot), []
                if lot:
                    yield _batch(n, lot)

    return work


def _batch(first: int, lot: list[list[str | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(lot)), pa.int64()), pa.array(lot, pa.list_(pa.string()))], names=["n", "cells"])


def _names(header: list[str | None], width: int) -> list[str]:
    """Distinct names for so many columns; those without a heading get their number."""
    out: list[str] = []
    for k in range(width):
        name = (header[k] if k < len(header) else None) or f"column_{k + 1}"
        while name in out:
            name += "_"
        out.append(name)
    return out


def read(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet's columns as text, named by its first row; rows that are shorter end in nulls."""
    rows = kept(spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed(sheet), "n long, cells array<string>"))
    head = rows.where("n = 0").first()
    if head is None:
        raise ValueError(f"{path} is empty")
    width = rows.agg(F.max(F.size("cells"))).first()[0]
    return rows.where("n > 0").select(*[F.get("cells", F.lit(k)).alias(name) for k, name in enumerate(_names(head.cells, width))])
