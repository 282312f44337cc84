"""Purchase orders (DOM-13…16, DOM-24, JOIN-3, JOIN-4, AGG-13, FN-24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allowed transitions.
ORDER_STEPS = {"draft": ("approved", "cancelled"), "approved": ("issued", "cancelled"), "issued": ("delivered", "cancelled"), "delivered": ("closed",)}
MESSAGE_STEPS = {"draft": ("approved", "cancelled"), "approved": ("sent", "cancelled")}


def tax_split(taxable: DataFrame, buyer: str = "buyer_state", supplier: str = "supplier_state") -> DataFrame:
    """DOM-14: tax lines of (po_id, rate, taxable, states): halves within a state (the second takes the rounding
    rest), one line across states, a plain one if a state is unknown; nothing at rate 0."""
    tax = F.round(F.col("taxable") * F.col("rate") / 100, 2)
    half = F.round(tax / 2, 2)
    line = lambda name, rate, amount: F.struct(F.lit(name).alias("name"), rate.alias("tax_rate"), amount.alias("amount"))
    r, known = F.col("rate").cast("double"), F.col(buyer).isNotNull() & F.col(supplier).isNotNull()
    lines = (
        F.when(known & (F.col(buyer) == F.col(supplier)), F.array(line("CGST", r / 2, half), line("SGST", r / 2, F.round(tax - half, 2))))
        .when(known, F.array(line("IGST", r, tax)))
        .otherwise(F.array(line("GST", r, tax)))
    )
    return taxable.where("rate <> 0").select("po_id", F.explode(lines).alias("t")).select("po_id", "t.*")


def taxable_by_rate(lines: DataFrame) -> DataFrame:
    """AGG-13."""
    return lines.groupBy("po_id", "rate").agg(F.round(F.sum("amount"), 2).alias("taxable"))


def order_lines(items: DataFrame, matches: DataFrame, quoted: DataFrame) -> DataFrame:
    """DOM-13, JOIN-3: requested quantity times matched price (a price of 0 falls back to the quoted one), with the
    line's tax rate, else the header's, else 0. items (request_item_id, quantity), matches (request_item_id, line_id,
    match_price), quoted (line_id, description, unit_price, tax, header_tax)."""
    price = F.coalesce(F.when(F.col("match_price") != 0, F.col("match_price")), F.col("unit_price"))
    joined = items.join(matches, "request_item_id").join(quoted, "line_id")
    return joined.select(
        "request_item_id", "description", "quantity", price.alias("unit_price"), F.coalesce("tax", "header_tax", F.lit(0.0)).alias("rate"),
        F.round(F.col("quantity") * price, 2).alias("amount"),
    )


def unmatched_items(items: DataFrame, matches: DataFrame) -> DataFrame:
    """JOIN-4."""
    return items.join(matches, "request_item_id", "left_anti")


def _allowed(steps: dict[str, tuple[str, ...]], old: Column, new: Column) -> Column:
    ok = F.lit(False)
    for a, targets in steps.items():
        ok = ok | ((old == a) & new.isin(*targets))
    return F.coalesce(ok, F.lit(False))


def transitions(requested: DataFrame, steps: dict[str, tuple[str, ...]] = ORDER_STEPS) -> DataFrame:
    """DOM-15, DOM-16: (id, status, wanted) with the new status, or an error where the step is not allowed."""
    ok = _allowed(steps, F.col("status"), F.col("wanted"))
    return requested.withColumns({
        "new_status": F.when(ok, F.col("wanted")).otherwise(F.col("status")),
        "error": F.when(~ok, F.concat_ws(" to ", "status", "wanted")),
    })


def record_delivery(orders: DataFrame) -> DataFrame:
    """DOM-15, FN-24: calendar days late; on time if none, unknown without an expected date."""
    days = F.datediff(F.to_date("delivered_at"), F.to_date("expected"))
    return orders.withColumns({"delay_days": days, "on_time": days <= 0})


def overdue(orders: DataFrame, drafts: DataFrame, now: Column) -> DataFrame:
    """DOM-24: issued orders past their date with no follow-up drafted yet, and how late they are."""
    open_ = orders.where((F.col("status") == "issued") & (F.col("expected") < now))
    return open_.join(drafts, "po_id", "left_anti").withColumn("days_late", F.datediff(F.to_date(now), F.to_date("expected")))
