"""Workbook reader (SRC-10, FN-17, FN-26): rows of every sheet, header rows by score, tables and texts.

A workbook is one small file (uploads end at 25 MB), read by one task; its rows are then ordinary rows of Spark. No
row is taken for the header by its place: the best-scoring of the first twenty is.
"""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of headers and the numbers of the score.
HEADER_WORDS = (
    "description", "item", "material", "product", "qty", "quantity", "units", "unit", "uom", "rate", "price", "amount", "total", "tax", "gst", "sr", "s.no", "sno", "particulars", "hsn",
    "value", "discount",
)
HEADER_ROWS, ROWS_BELOW, LEAST_CELLS, LEAST_TEXTS, SAME_WIDTH, WIDE, ALONE, PER_WORD = 20, 5, 2, 0.6, 0.6, 1.6, 0.5, 2.0
DATE_FORMATS = {*range(14, 23), 45, 46, 47}
SCHEMA = "path string, sheet_no int, sheet string, row int, cells array<string>, texts array<boolean>, error string"


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: one row per sheet row with a cell: path, sheet_no and row (from 1), sheet, cells as text and ``texts``, which says
    where the sheet has a text or a date. Trailing blanks are left out, errors are null. A file that cannot be read gives
    one row with ``error`` and no sheet."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_rows, SCHEMA)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                found = [(path, *row, None) for row in workbook_rows(content)]
            except (zipfile.BadZipFile, KeyError, ValueError, IndexError, ElementTree.ParseError) as e:
                found = [(path, None, None, None, None, None, f"unreadable workbook: {e}")]
            yield pd.DataFrame(found, columns=columns)


def _children(node, name: str):
    return [x for x in node if x.tag.rpartition("}")[2] == name]


def _text(node) -> str:
    """The text of a string item, all its runs, without phonetic hints."""
    return "".join((x.text or "") if x.tag.endswith("}t") else _text(x) for x in node if x.tag.rpartition("}")[2] in ("t", "r"))


def workbook_rows(content: bytes) -> Iterator[tuple[int, str, int, list[str | None], list[bool]]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names, tree = set(z.namelist()), lambda name: ElementTree.fromstring(z.read(name))
        strings = [_text(x) for x in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        dates = _date_styles(tree("xl/styles.xml")) if "xl/styles.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        sheets = [s for part in _children(tree("xl/workbook.xml"), "sheets") for s in part]
        for number, sheet in enumerate(sheets, 1):
            target = targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            row = 0
            with z.open(posixpath.normpath(posixpath.join("xl", target)).lstrip("/")) as f:
                for _, node in ElementTree.iterparse(f):
                    if node.tag.endswith("}row"):
                        cells = _cells(node, strings, dates)
                        if cells:
                            row += 1
                            yield number, sheet.get("name"), row, [c for c, _ in cells], [t for _, t in cells]
                        node.clear()


def _date_styles(styles) -> list[bool]:
    custom = {int(x.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", x.get("formatCode")) for part in _children(styles, "numFmts") for x in part}
    ids = [int(x.get("numFmtId", 0)) for part in _children(styles, "cellXfs") for x in part]
    return [k in DATE_FORMATS or bool(re.search("[dmyhs]", custom.get(k, "").lower().replace("general", ""))) for k in ids]


def _cells(row, strings: list[str], dates: list[bool]) -> list[tuple[str | None, bool]]:
    """(text, is text or date) of the cells of a row up to the last that is not blank."""
    out: list[tuple[str | None, bool]] = []
    for cell in _children(row, "c"):
        place = re.match("[A-Z]+", cell.get("r", ""))
        column = len(out) + 1
        if place:
            column = 0
            for letter in place[0]:
                column = column * 26 + ord(letter) - 64
        out += [(None, False)] * (column - 1 - len(out)) + [_cell(cell, strings, dates)]
    while out and out[-1][0] is None:
        out.pop()
    return out


def _cell(cell, strings: list[str], dates: list[bool]) -> tuple[str | None, bool]:
    kind, style = cell.get("t", "n"), int(cell.get("s", 0))
    if kind == "inlineStr":
        return _blank("".join(_text(x) for x in _children(cell, "is")))
    value = next((x.text for x in _children(cell, "v") if x.text), None)
    if value is None or kind == "e":
        return None, False
    if kind in ("s", "str", "d"):
        return _blank(strings[int(value)] if kind == "s" else value)
    if kind == "b":
        return str(value == "1"), False
    n = float(value)
    if style < len(dates) and dates[style]:
        moment = datetime.datetime(1899, 12, 30) + datetime.timedelta(seconds=round(n * 86400))
        return (moment if n >= 1 else moment.time()).isoformat(), True
    return (str(int(n)) if n.is_integer() else str(round(n, 6))), False


def _blank(s: str) -> tuple[str | None, bool]:
    s = s.strip()
    return (s, True) if s else (None, False)


def _width(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: c.isNotNull()))


def header_score(row: Column, below: Column) -> Column:
    """FN-17: score of a row (cells, texts) before the rows ``below``: its texts, more where the next rows are about as wide and for words
    of headers, less where nothing follows; 0 under two cells or mostly numbers."""
    width, texts = _width(row["cells"]), F.size(F.filter(row["texts"], lambda t: t))
    words = F.lit(0)
    lowered = F.transform(F.filter(F.arrays_zip(row["cells"].alias("c"), row["texts"].alias("t")), lambda x: x["t"]), lambda x: F.lower(x["c"]))
    for hit in (lambda c: c.isin(*HEADER_WORDS), lambda c: c.rlike("|".join(map(re.escape, HEADER_WORDS)))):
        words = words + F.size(F.filter(lowered, hit))
    sample = F.slice(below, 1, ROWS_BELOW)
    mean = F.try_divide(F.aggregate(sample, F.lit(0), lambda a, r: a + _width(r["cells"])), F.size(sample))
    shape = F.when(mean.isNull(), ALONE).when(mean >= width * SAME_WIDTH, WIDE).otherwise(1.0)
    return F.when((width >= LEAST_CELLS) & (texts >= width * LEAST_TEXTS), texts * shape + words * PER_WORD).otherwise(0.0)


def headers(rows: DataFrame) -> DataFrame:
    """SRC-10: path, sheet_no, sheet, header_row and headers, as wide as the widest row; ``col_<n>`` where a cell is blank.
    Of equal scores the first row wins. Only the first rows of a sheet are brought together."""
    top = F.when(F.col("row") <= HEADER_ROWS + ROWS_BELOW, F.struct("row", "cells", "texts"))
    sheets = rows.where("sheet_no is not null").groupBy("path", "sheet_no", "sheet").agg(F.array_sort(F.collect_list(top)).alias("top"), F.max(F.size("cells")).alias("width"))
    scored = F.transform(F.slice("top", 1, HEADER_ROWS), lambda r: F.struct(
        (-header_score(r, F.slice("top", r["row"] + 1, F.lit(ROWS_BELOW)))).alias("score"), r["row"].alias("row"), r["cells"].alias("cells")
    ))
    best = sheets.select("path", "sheet_no", "sheet", "width", F.array_min(scored).alias("best"))
    names = F.transform(F.sequence(F.lit(1), F.col("width")), lambda j: F.coalesce(F.get("best.cells", j - 1), F.concat(F.lit("col_"), j.cast("string"))))
    return best.select("path", "sheet_no", "sheet", F.col("best.row").alias("header_row"), names.alias("headers"))


def sheet_tables(rows: DataFrame) -> DataFrame:
    """SRC-10: the body rows of every sheet with their headers, cells as many as headers; ``row`` counts from 1 below the header."""
    named = rows.where("sheet_no is not null").drop("sheet", "error").join(headers(rows), ["path", "sheet_no"]).where("row > header_row")
    cells = F.transform(F.sequence(F.lit(1), F.size("headers")), lambda j: F.get("cells", j - 1))
    return named.select("path", "sheet_no", "sheet", (F.col("row") - F.col("header_row")).alias("row"), "headers", cells.alias("cells"))


def sheet_texts(rows: DataFrame) -> DataFrame:
    """SRC-10: each sheet as text: its name, the rows above the header, the header and the body with bars. A text holds one
    sheet of one upload."""
    named = rows.where("sheet_no is not null").drop("sheet", "error").join(headers(rows), ["path", "sheet_no"])
    padded = F.transform(F.sequence(F.lit(1), F.size("headers")), lambda j: F.coalesce(F.get("cells", j - 1), F.lit("")))
    line = F.when(F.col("row") < F.col("header_row"), F.array_join("cells", " ")).when(F.col("row") == F.col("header_row"), F.array_join("headers", " | ")).otherwise(F.array_join(padded, " | "))
    lines = F.array_sort(F.collect_list(F.struct("row", line.alias("line"))))
    out = named.groupBy("path", "sheet_no", "sheet").agg(lines.alias("lines"))
    return out.select("path", "sheet_no", "sheet", F.concat(F.lit("=== Sheet: "), "sheet", F.lit(" ===\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("text"))
