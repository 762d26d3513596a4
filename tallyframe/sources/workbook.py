"""Workbooks (.xlsx, .xlsm) decoded inside Spark tasks.

Each workbook is one file-source row and becomes one grid row per sheet row.
Only the standard library is used; a workbook is bounded by its format, and
rows leave the task in chunks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from decimal import Decimal
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import full_path

GLOB = "*.[xX][lL][sS][xXmM]"
GRID = "file string, sheet string, row_idx bigint, cells array<string>, error string"
CHUNK_ROWS = 5_000

# Built-in number formats that show dates.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
# Parts of a number format that are shown as they are: quoted, escaped, in brackets.
_FORMAT_TEXT = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]|_.')
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _xml(book: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _texts(node) -> str:
    skipped = {id(t) for ph in node.iter(f"{_NS}rPh") for t in ph.iter(f"{_NS}t")}
    return "".join(t.text or "" for t in node.iter(f"{_NS}t") if id(t) not in skipped)


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell style numbers whose number format shows a date."""
    root = _xml(book, "xl/styles.xml")
    if root is None:
        return set()
    custom = {}
    for fmt in root.iter(f"{_NS}numFmt"):
        code = _FORMAT_TEXT.sub("", fmt.get("formatCode", "").lower())
        custom[int(fmt.get("numFmtId"))] = "general" not in code and bool(set("ymdhs") & set(code))
    styles = root.find(f"{_NS}cellXfs")
    formats = [int(xf.get("numFmtId", 0)) for xf in styles] if styles is not None else []
    return {i for i, f in enumerate(formats) if custom.get(f, f in DATE_FORMATS)}


def _column(ref: str) -> int:
    index = 0
    for char in ref:
        if not char.isalpha():
            break
        index = index * 26 + ord(char.upper()) - 64
    return index - 1


def _as_date(serial: str, origin: datetime) -> str:
    moment = origin + timedelta(seconds=round(float(serial) * 86_400))
    return moment.strftime("%Y-%m-%d %H:%M:%S" if moment.time() != datetime.min.time() else "%Y-%m-%d")


def _value(cell, shared: list[str], dates: set[int], origin: datetime) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _texts(cell)
    raw = cell.findtext(f"{_NS}v")
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return "TRUE" if raw == "1" else "FALSE"
    if kind != "n":
        return raw
    if int(cell.get("s", 0)) in dates:
        return _as_date(raw, origin)
    return format(Decimal(raw), "f")


def _sheet_rows(stream, shared, dates, origin) -> Iterator[tuple[int, list]]:
    number = -1
    for _, row in ElementTree.iterparse(stream):
        if row.tag != f"{_NS}row":
            continue
        number = int(row.get("r", number + 2)) - 1
        cells: list[str | None] = []
        for cell in row.iter(f"{_NS}c"):
            at = _column(cell.get("r", "")) if cell.get("r") else len(cells)
            cells.extend([None] * (at - len(cells) + 1))
            cells[at] = _value(cell, shared, dates, origin)
        row.clear()
        if any(c is not None for c in cells):
            yield number, cells


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, list]]:
    """``(sheet, row_idx, cells)`` of all worksheets; blank rows are skipped."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        root = _xml(book, "xl/workbook.xml")
        props = root.find(f"{_NS}workbookPr")
        old_epoch = props is not None and props.get("date1904") in ("1", "true")
        origin = datetime(1904, 1, 1) if old_epoch else datetime(1899, 12, 30)
        links = {r.get("Id"): r.get("Target") for r in _xml(book, "xl/_rels/workbook.xml.rels")}
        strings = _xml(book, "xl/sharedStrings.xml")
        shared = [_texts(si) for si in strings.iter(f"{_NS}si")] if strings is not None else []
        dates = _date_styles(book)
        for sheet in root.iter(f"{_NS}sheet"):
            target = links[sheet.get(_REL)]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if "worksheets/" not in part:
                continue
            with book.open(part) as stream:
                for number, cells in _sheet_rows(stream, shared, dates, origin):
                    yield sheet.get("name"), number, cells


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["file", "sheet", "row_idx", "cells", "error"]
    for batch in batches:
        for file, content in zip(batch["file"], batch["content"]):
            chunk: list[tuple] = []
            try:
                for sheet, number, cells in workbook_rows(content):
                    chunk.append((file, sheet, number, cells, None))
                    if len(chunk) == CHUNK_ROWS:
                        yield pd.DataFrame(chunk, columns=names)
                        chunk = []
            except Exception as problem:  # a broken workbook must not stop the batch
                chunk.append((file, None, None, None, f"{type(problem).__name__}: {problem}"))
            if chunk:
                yield pd.DataFrame(chunk, columns=names)


def decode_workbooks(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rows of all workbooks under ``paths``; a broken one yields one error row."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", GLOB)
        .load(list(paths))
        .select(full_path().alias("file"), "content")
    )
    return files.mapInPandas(_decode, GRID)
