"""Validation of extracted quotations (DOM-4, AGG-15, AGG-25, DOM-21).

A quotation is one row with struct columns ``supplier`` (name, email, gst_number), ``quotation`` (date),
``commercials`` (subtotal, tax_amount, tax_percentage, total_amount, transportation_cost, delivery_days, payment_days)
and an array ``items`` (original_name, quantity, unit_price, gst_percentage, total_price). Every check flags, none fixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.gstin import is_valid_gstin
from ..functions.numbers import close_enough

# Limits of plausibility.
MAX_QUANTITY, MAX_PRICE, MAX_TOTAL, MAX_AGE_DAYS, MAX_TAX, MAX_DAYS = 1e6, 1e7, 1e9, 1095, 40, 365
REVIEW_WARNINGS = 3
E_, W_ = "ERROR", "WARNING"


def _issue(when: Column, code: str, severity: str | Column) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), level.alias("severity")))


def _some(issues: list[Column]) -> Column:
    return F.array_compact(F.array(*issues))


def _line_issues(x: Column) -> Column:
    name, q, p, total, tax = x["original_name"], x["quantity"], x["unit_price"], x["total_price"], x["gst_percentage"]
    lacking = q.isNull() | p.isNull() | total.isNull()
    only_total = total.isNotNull() & q.isNull() & p.isNull()
    return _some([
        _issue(name.isNull() | (F.trim(name) == ""), "missing_item_name", E_),
        _issue(q <= 0, "non_positive_quantity", E_),
        _issue(q > MAX_QUANTITY, "implausible_quantity", W_),
        _issue(p < 0, "negative_price", E_),
        _issue(p > MAX_PRICE, "implausible_price", W_),
        _issue((tax < 0) | (tax > MAX_TAX), "implausible_tax_rate", W_),
        _issue(total < 0, "negative_total", E_),
        _issue(~close_enough(q * p, total), "line_total_mismatch", W_),
        _issue(lacking, "incomplete_item", F.when(only_total, E_).otherwise(W_)),
    ])


def validate(quotations: DataFrame, as_of: Column) -> DataFrame:
    """DOM-4: ``issues`` as an array of (code, severity), counts of both severities and the review verdict."""
    s, q, c, items = F.col("supplier"), F.col("quotation"), F.col("commercials"), F.coalesce("items", F.array().cast("array<struct<original_name:string,quantity:double,unit_price:double,gst_percentage:double,total_price:double>>"))
    date = parse_date(q["date"])
    totals = F.transform(items, lambda x: x["total_price"])
    summed = F.aggregate(totals, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    priced = (F.size(items) > 0) & ~F.exists(totals, lambda t: t.isNull())
    total = c["total_amount"]
    tax = F.coalesce(c["tax_amount"], c["subtotal"] * c["tax_percentage"] / 100, F.lit(0.0))
    expected = c["subtotal"] + tax + F.coalesce(c["transportation_cost"], F.lit(0.0))
    header = _some([
        _issue(s["name"].isNull() | (F.trim(s["name"]) == ""), "missing_supplier_name", W_),
        _issue(s["gst_number"].isNotNull() & ~is_valid_gstin(s["gst_number"]), "invalid_gst_format", W_),
        _issue(~s["email"].rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "invalid_email", W_),
        _issue(q["date"].isNotNull() & (F.trim(q["date"]) != "") & date.isNull(), "unparseable_date", W_),
        _issue(date > F.to_date(as_of), "future_date", W_),
        _issue(F.datediff(as_of, date) > MAX_AGE_DAYS, "very_old_date", W_),
        _issue(F.size(items) == 0, "no_items", E_),
    ])
    money = _some([
        _issue(priced & ~close_enough(summed, c["subtotal"]), "subtotal_mismatch", W_),
        _issue((c["tax_percentage"] < 0) | (c["tax_percentage"] > MAX_TAX), "implausible_tax_rate", W_),
        _issue(~close_enough(expected, total), "total_mismatch", W_),
        _issue(total <= 0, "non_positive_total", E_),
        _issue(total > MAX_TOTAL, "implausible_total", W_),
        _issue(total.isNull(), "missing_total", W_),
        _issue((c["delivery_days"] < 0) | (c["delivery_days"] > MAX_DAYS), "implausible_delivery", W_),
        _issue((c["payment_days"] < 0) | (c["payment_days"] > MAX_DAYS), "implausible_payment_terms", W_),
    ])
    issues = F.concat(header, F.flatten(F.transform(items, _line_issues)), money)
    n = lambda level: F.size(F.filter("issues", lambda i: i["severity"] == level))
    out = quotations.withColumn("issues", issues).withColumns({"error_count": n(E_), "warning_count": n(W_)})
    return out.withColumn("needs_review", (F.col("error_count") > 0) | (F.col("warning_count") >= REVIEW_WARNINGS))


def confidence(validated: DataFrame, ocr: Column | None = None) -> DataFrame:
    """AGG-25, DOM-21: share of filled cells, a penalty for issues, and the mean of the known parts."""
    cells = F.flatten(F.transform("items", lambda x: F.array(
        x["original_name"].isNotNull(), x["quantity"].isNotNull(), x["unit_price"].isNotNull(), x["total_price"].isNotNull()
    )))
    filled = F.size(F.filter(cells, lambda b: b))
    extraction = F.coalesce(F.round(F.try_divide(filled, F.when(F.size(cells) > 0, F.size(cells))), 4), F.lit(0.0))
    penalty = F.least(F.col("error_count") * 0.15 + F.col("warning_count") * 0.03, F.lit(0.6))
    normal = F.round(F.greatest(F.lit(0.0), 1.0 - penalty), 4)
    parts = F.array_compact(F.array(F.lit(None).cast("double") if ocr is None else ocr, extraction, normal))
    mean = F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts), 4)
    return validated.withColumns({"extraction_confidence": extraction, "normalization_confidence": normal, "overall_confidence": mean})
