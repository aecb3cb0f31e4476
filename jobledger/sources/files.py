"""Irregular schedule files: CSV with preamble and ragged rows, and XLSX workbooks, read by whole files."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobledger.operators.parse import parse_cell, sniff


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, content, length and type (by first bytes, then name) of every file."""
    return spark.read.format("binaryFile").load(path).select("path", "content", "length", sniff(F.col("path"), F.col("content")).alias("type"))


def _rows(content: bytes) -> list[list[str]]:
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("latin-1")
    lines = text.splitlines()
    best = max(",;\t|", key=lambda d: sum(line.count(d) for line in lines[:50]))
    return [row for row in csv.reader(io.StringIO(text), delimiter=best)]


#: Number formats of a workbook that are percentages without being spelt out in it.
PERCENT_FORMATS = {9: 0, 10: 2}


def _printed(value: str, decimals: int | None) -> str:
    """A cell's number as it prints: as a percentage, whole without decimals, others with two."""
    try:
        x = float(value)
    except ValueError:
        return value
    if decimals is not None:
        return f"{x * 100:.{decimals}f}".rstrip("0").rstrip(".") + "%" if decimals else f"{x * 100:.0f}%"
    return f"{x:.0f}" if x == int(x) else f"{x:.2f}"


def _sheets(content: bytes) -> Iterator[list[list[str]]]:
    """Grids of a workbook's sheets, from its XML parts."""
    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        part = lambda name: ElementTree.fromstring(book.read(name)) if name in names else ElementTree.Element("none")
        shared = ["".join(x.text or "" for x in item.iter() if local(x) == "t") for item in part("xl/sharedStrings.xml")]
        styles = part("xl/styles.xml")
        codes = {int(x.get("numFmtId", 0)): x.get("formatCode", "") for x in styles.iter() if local(x) == "numFmt"}
        percent: list[int | None] = []
        for group in (x for x in styles if local(x) == "cellXfs"):
            for x in group:
                k = int(x.get("numFmtId", 0))
                code = codes.get(k, "")
                percent.append(PERCENT_FORMATS.get(k, len(code.partition(".")[2].partition("%")[0]) if "%" in code else None))
        for name in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n))):
            rows: list[list[str]] = []
            for row in (x for x in part(name).iter() if local(x) == "row"):
                cells: dict[int, str] = {}
                for c in row:
                    column = 0
                    for letter in re.sub(r"[^A-Z]", "", c.get("r", "")):
                        column = column * 26 + ord(letter) - 64
                    value = next((x.text or "" for x in c if local(x) == "v"), "")
                    if c.get("t") == "s":
                        value = shared[int(value)] if value else ""
                    elif c.get("t") == "inlineStr":
                        value = "".join(x.text or "" for x in c.iter() if local(x) == "t")
                    elif c.get("t") in (None, "n") and value:
                        style = int(c.get("s", 0))
                        value = _printed(value, percent[style] if style < len(percent) else None)
                    cells[(column or len(cells) + 1) - 1] = value
                rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
            yield rows


def _best_sheet(content: bytes) -> list[list[str]]:
    """The sheet with the most rows of four numbers or more; of equals the first.  A file that is no workbook has no rows."""
    numeric = lambda c: re.fullmatch(r"[$(-]*[\d.,]+[)%]*", c.strip()) is not None
    try:
        sheets = list(_sheets(content))
    except (zipfile.BadZipFile, ElementTree.ParseError):
        return []
    return max(sheets, key=lambda rows: sum(sum(map(numeric, r)) >= 4 for r in rows), default=[])


def grids(files: DataFrame) -> DataFrame:
    """path, row number and cells of every CSV-like file and workbook (its best sheet)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            read = ((p, _best_sheet(bytes(c)) if kind == "xlsx" else _rows(bytes(c))) for p, c, kind in zip(part["path"], part["content"], part["type"], strict=True))
            yield pd.DataFrame([(p, k, row) for p, rows in read for k, row in enumerate(rows)], columns=["path", "row", "cells"])

    return files.where("type in ('csv', 'xlsx')").select("path", "content", "type").mapInPandas(run, "path string, row int, cells array<string>")


def tables(grid: DataFrame, least_numeric: int = 4, least_header: int = 3, look_back: int = 7) -> DataFrame:
    """path, headers and rows: the body begins at the first row of four numeric cells or more; the header is the nearest of the seven rows before with three filled cells or more and no number."""
    filled = F.filter("cells", lambda c: F.trim(c) != "")
    numeric = F.size(F.filter(filled, lambda c: parse_cell(c, repair=False)["value"].isNotNull()))
    g = grid.select("path", "row", "cells", numeric.alias("numeric"), F.size(filled).alias("filled"))
    start = g.where(F.col("numeric") >= least_numeric).groupBy("path").agg(F.min("row").alias("start"))
    near = g.join(start, "path")
    header = near.where((F.col("row") < F.col("start")) & (F.col("row") >= F.col("start") - look_back) & (F.col("numeric") == 0) & (F.col("filled") >= least_header))
    header = header.groupBy("path").agg(F.max_by("cells", "row").alias("headers"))
    body = near.where("row >= start and filled > 0").groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("rows"))
    before = near.where("row < start").groupBy("path").agg(F.collect_list(F.array_join("cells", " ")).alias("preamble"))
    return body.join(header, "path", "left").join(before, "path", "left").select("path", "headers", "rows", "preamble")
