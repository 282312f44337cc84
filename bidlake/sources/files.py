"""File readers (SRC-9, SRC-10, SRC-13…17, FN-17, FN-26)."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# First bytes, limits, and words that headers use.
MAGIC = (("25504446", "pdf"), ("504B0304", "xlsx"), ("D0CF11E0", "xls"), ("89504E47", "image"), ("FFD8FF", "image"))
EXTENSIONS = {"pdf": "pdf", "xlsx": "xlsx", "xls": "xls", "csv": "csv", "tsv": "csv", "txt": "text", "eml": "email", "png": "image", "jpg": "image", "jpeg": "image"}
MAX_BYTES = 25 * 1024 * 1024
HEADER_WORDS = ("item", "description", "product", "particular", "qty", "quantity", "unit", "uom", "rate", "price", "amount", "total", "gst", "tax", "hsn")
HEADER_ROWS = 20


def detect_type(content: Column, mime: Column, path: Column) -> Column:
    """SRC-14: first bytes, else MIME type, else extension."""
    head = F.hex(F.substring(content, 1, 4))
    by_magic = F.coalesce(*[F.when(head.startswith(m), F.lit(k)) for m, k in MAGIC])
    by_mime = F.when(mime == "application/pdf", "pdf").when(mime.startswith("image/"), "image").when(mime == "text/csv", "csv").when(mime == "text/plain", "text").when(mime == "message/rfc822", "email")
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(by_magic, by_mime, F.try_element_at(F.create_map(*[F.lit(x) for p in EXTENSIONS.items() for x in p]), ext), F.lit("unknown"))


def allowed_upload(df: DataFrame) -> DataFrame:
    """SRC-15: not empty, not over 25 MB, of a known type."""
    size = F.length("content")
    return df.where((size > 0) & (size <= MAX_BYTES) & (F.col("type") != "unknown"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: whole files as text, undecodable bytes replaced."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))


def decode_table(data: bytes) -> str:
    for encoding in ("utf-8-sig", "utf-8"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def clean_value(value: str | None) -> str | None:
    """FN-26 on one cell."""
    s = (value or "").strip()
    if not s or s.lower() == "nan":
        return None
    try:
        n = float(s)
    except ValueError:
        return s
    return str(int(n)) if n.is_integer() and abs(n) < 1e15 else str(round(n, 6))


def parse_table(data: bytes) -> list[list[str | None]]:
    """SRC-9: separator found by counting in the first lines; rows without a cell are left out."""
    text = decode_table(data)
    head = text.splitlines()[:10]
    separator = max(",;\t|", key=lambda s: (sum(s in line for line in head), sum(line.count(s) for line in head)))
    rows = [[clean_value(c) for c in row] for row in csv.reader(io.StringIO(text), delimiter=separator)]
    return [r for r in rows if any(c is not None for c in r)]


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: one row per file: header (first row) and cells as text."""

    @F.pandas_udf("array<array<string>>")
    def parsed(content: pd.Series) -> pd.Series:
        return content.map(parse_table)

    files = spark.read.format("binaryFile").load(path).select("path", parsed("content").alias("cells"))
    return files.select("path", F.try_element_at("cells", F.lit(1)).alias("header"), F.slice("cells", F.lit(2), F.greatest(F.size("cells"), F.lit(1))).alias("rows"))


def header_score(row: list[str | None]) -> float:
    """FN-17: how much a row looks like a header: known words, texts rather than numbers, filled cells."""
    filled = [c for c in row if c]
    if len(filled) < 2:
        return 0.0
    words = sum(any(w in c.lower() for w in HEADER_WORDS) for c in filled)
    numbers = sum(c.replace(".", "", 1).replace(",", "").isdigit() for c in filled)
    return 2.0 * words + 0.5 * (len(filled) - numbers) / len(filled) - numbers


def best_header(rows: list[list[str | None]]) -> int:
    """SRC-10: index of the best-scoring of the first rows, the first of equals."""
    return max(range(min(HEADER_ROWS, len(rows))), key=lambda k: (header_score(rows[k]), -k), default=0)


def clean_shipments(raw: DataFrame) -> DataFrame:
    """SRC-16: all-text shipment rows to typed ones with ``late`` and ``delay_days``; placeholders become null."""
    number = lambda c: F.trim(F.col(c)).try_cast("double")
    date = lambda c: F.to_date(F.try_to_timestamp(F.trim(F.col(c)), F.lit("d-MMM-yy")))
    typed = raw.withColumns({"scheduled_date": date("scheduled_date"), "delivered_date": date("delivered_date"), "value": number("value"), "quantity": number("quantity")})
    days = F.datediff("delivered_date", "scheduled_date")
    # SNK-9 quirk: a zero or missing unit price falls back to value per unit, 0 without a quantity
    price = F.coalesce(F.when(number("unit_price") != 0, number("unit_price")), F.try_divide(F.col("value"), F.when(F.col("quantity") != 0, F.col("quantity"))), F.lit(0.0))
    return typed.withColumns({"delay_days": days, "late": days > 0, "unit_price": price, "shipment_mode": F.coalesce(F.nullif(F.trim("shipment_mode"), F.lit("")), F.lit("unknown"))})


def as_orders(shipments: DataFrame) -> DataFrame:
    """SRC-17."""
    return shipments.select(F.col("vendor").alias("supplier_key"), "scheduled_date", "delivered_date", F.col("value").alias("order_value"), "quantity", "shipment_mode", "fulfil_via")
