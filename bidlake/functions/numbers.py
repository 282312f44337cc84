"""Number functions (FN-1, FN-2, FN-3, FN-10, FN-16, FN-19, FN-23, FN-26, FN-28, FN-29)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "nothing", and what is stripped from numbers, in this order.
NULLISH = ("", "n/a", "na", "none", "null", "-", "--", "unknown", "not specified", "nil", "tbd")
NUMBER_NOISE = (",", "₹", "Rs.", "Rs", "INR", "%", "/-", "$")
CLOSE_ABSOLUTE, CLOSE_RELATIVE = 1.0, 0.02


def blank_to_none(c: Column) -> Column:
    """FN-1: trimmed text, null if it is empty or says that nothing is known."""
    s = F.trim(c)
    return F.when(~F.lower(s).isin(*NULLISH), s)


def coerce_number(c: Column) -> Column:
    """FN-2: messy amount to double, null where that fails."""
    s = blank_to_none(c)
    for noise in NUMBER_NOISE:
        s = F.replace(s, F.lit(noise), F.lit(""))
    return F.trim(s).try_cast("double")


def coerce_int(c: Column) -> Column:
    """FN-3: FN-2 cut toward zero."""
    n = coerce_number(c)
    return F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).try_cast("int")


def close_enough(a: Column, b: Column) -> Column:
    """FN-10: equal within 1.0 or two per cent of the larger."""
    return F.abs(a - b) <= F.greatest(F.lit(CLOSE_ABSOLUTE), F.lit(CLOSE_RELATIVE) * F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))


def log_feature(c: Column) -> Column:
    """FN-16: log1p of what is above 0; null counts as 0."""
    return F.log1p(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)))


def category(c: Column) -> Column:
    """FN-16: trimmed category, ``unknown`` if blank."""
    return F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit("unknown"))


def smape_term(actual: Column, predicted: Column) -> Column:
    """FN-23: one term of the symmetric percentage error; 0/0 counts as 0."""
    size = F.abs(actual) + F.abs(predicted)
    return F.when(size == 0, 0.0).otherwise(200.0 * F.abs(actual - predicted) / F.when(size != 0, size))


def floor_percent(rate: Column) -> Column:
    """FN-28: whole per cent, robust against a rate just below."""
    return F.floor(rate * 100 + 1e-9)


def positive_finite(c: Column) -> Column:
    """FN-29: usable as a price."""
    return c.isNotNull() & ~F.isnan(c) & (c > 0) & (c != float("inf"))


def clean_cell(c: Column) -> Column:
    """FN-26: a cell of a sheet as text: blank and NaN to null, whole numbers without a point, others to six places."""
    s = F.trim(c)
    n = s.try_cast("double")
    whole = n.isNotNull() & (n == F.floor(n)) & (F.abs(n) < 1e15)
    text = F.when(whole, n.cast("long").cast("string")).when(n.isNotNull(), F.round(n, 6).cast("string")).otherwise(s)
    return F.when((s != "") & (F.lower(s) != "nan"), text)


def money(c: Column, currency: str = "INR") -> Column:
    """FN-19: amount for messages."""
    return F.concat(F.lit(currency + " "), F.format_number(c, 2))


def percent(c: Column) -> Column:
    """FN-19: share for messages."""
    return F.concat(F.format_string("%.0f", c * 100), F.lit("%"))
