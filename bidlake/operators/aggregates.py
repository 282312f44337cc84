"""Aggregates (AGG-1…11, AGG-17…22, AGG-27, AGG-29, JOIN-1, JOIN-5, JOIN-9, SNK-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.driver import COMMITTED


def committed(orders: DataFrame) -> DataFrame:
    """FIL-9."""
    return orders.where(F.col("status").isin(*COMMITTED))


def rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)


def spend_by_supplier(orders: DataFrame) -> DataFrame:
    """AGG-7: spend, orders and the on-time rate of those delivered; most spend first."""
    out = committed(orders).groupBy("supplier_id").agg(
        F.round(F.sum("total"), 2).alias("spend"), F.count("*").alias("orders"), F.count("on_time").alias("delivered"), F.count_if("on_time").alias("on_time"),
    )
    return out.withColumn("on_time_rate", rate(F.col("on_time"), F.col("delivered"))).orderBy(F.desc("spend"), "supplier_id")


def spend_by_month(orders: DataFrame) -> DataFrame:
    """AGG-8."""
    return committed(orders).groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.round(F.sum("total"), 2).alias("spend"))


def spend_by_item(lines: DataFrame) -> DataFrame:
    """AGG-9: over exploded lines (item, quantity, amount)."""
    return lines.groupBy("item").agg(F.round(F.sum("amount"), 2).alias("spend"), F.sum("quantity").alias("quantity"))


def savings(orders: DataFrame, quotations: DataFrame) -> DataFrame:
    """AGG-10, JOIN-5: highest of several quotes less what was awarded, per committed order."""
    quoted = quotations.where("landed <> 0").groupBy("request_id").agg(F.max("landed").alias("highest"), F.count("*").alias("quotes")).where("quotes > 1")
    joined = committed(orders).join(quoted, "request_id")
    return joined.select("po_id", "request_id", "highest", "total", (F.col("highest") - F.col("total")).alias("saved"))


def count_by(df: DataFrame, key: str = "status") -> DataFrame:
    """AGG-1."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def price_stats(history: DataFrame) -> DataFrame:
    """AGG-2: per item; the sample deviation of one price is null."""
    p = F.col("unit_price")
    return history.groupBy("item").agg(F.avg(p).alias("mean"), F.stddev_samp(p).alias("stddev"), F.min(p).alias("low"), F.max(p).alias("high"), F.count(p).alias("n"))


def rollup_counts(requests: DataFrame) -> DataFrame:
    """AGG-5: dashboard totals in one row."""
    s = F.col("status")
    return requests.agg(F.count("*").alias("total"), F.count_if(s.isin("open", "comparing")).alias("active"), F.count_if(s == "closed").alias("closed"))


def fingerprint(df: DataFrame, stamp: str) -> DataFrame:
    """AGG-6: version of a table, for result caches."""
    return df.agg(F.count("*").alias("n"), F.max(stamp).alias("latest"))


def supplier_performance(orders: DataFrame) -> DataFrame:
    """AGG-17."""
    return orders.where("status = 'delivered'").groupBy("supplier_id").agg(
        F.count("*").alias("delivered"), F.count_if(~F.col("on_time")).alias("late"), F.max(F.coalesce("delay_days", F.lit(0))).alias("worst_delay")
    )


def request_counts(requests: DataFrame, quotations: DataFrame) -> DataFrame:
    """JOIN-1: every request with its number of quotations; counted before the join."""
    n = quotations.groupBy("request_id").agg(F.count("*").alias("quotations"))
    return requests.join(n, "request_id", "left").select("request_id", "status", F.coalesce("quotations", F.lit(0)).cast("long").alias("quotations"))


def counts_for(suppliers: DataFrame, quotations: DataFrame) -> DataFrame:
    """JOIN-9: quotation counts of a page of suppliers."""
    return quotations.join(suppliers, "supplier_id", "left_semi").groupBy("supplier_id").agg(F.count("*").alias("quotations"))


def distinct_concat(df: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """AGG-22: distinct texts of a key in the order of their first appearance, one string."""
    first = df.groupBy(key, text).agg(F.min(order).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", text)))
    return first.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x[text]), " ").alias("joined"))


def price_evidence(wanted: DataFrame, history: DataFrame, limit: int = 10) -> DataFrame:
    """AGG-29: statistics of the first ``limit`` wanted items (item, position) that have a history."""
    top = wanted.orderBy("position").limit(limit)
    stats = price_stats(history.join(top, "item", "left_semi"))
    return stats.select("item", F.round("mean", 2).alias("mean"), "low", "high", "n")


def order_numbers(orders: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """SNK-6: gap-free PO-<year>-<0001> per supplier organisation and year, going on after the largest number
    in ``stored`` (supplier_id, po_number). Orders of one organisation and year are numbered in one task."""
    year = F.year("created_at")
    n = F.row_number().over(W.partitionBy("supplier_id", year).orderBy("created_at", "po_id"))
    if stored is not None:
        parts = F.split("po_number", "-")
        last = stored.groupBy("supplier_id", parts[1].cast("int").alias("_year")).agg(F.max(parts[2].cast("int")).alias("_last"))
        last = last.withColumnRenamed("supplier_id", "_org")
        orders = orders.join(last, (F.col("supplier_id") == F.col("_org")) & (year == F.col("_year")), "left")
        n = n + F.coalesce("_last", F.lit(0))
    return orders.select("po_id", "supplier_id", F.format_string("PO-%d-%04d", year, n).alias("po_number"))


def median_by_supplier(deliveries: DataFrame) -> DataFrame:
    """AGG-18."""
    return deliveries.groupBy("supplier_key").agg(F.median("order_value").alias("median_value"), F.median("quantity").alias("median_quantity"))


def late_rate_by_year(deliveries: DataFrame) -> DataFrame:
    """AGG-21."""
    late = (F.col("delivered") > F.col("scheduled")).cast("int")
    return deliveries.groupBy(F.year("scheduled").alias("year")).agg(F.count("*").alias("n"), F.avg(late).alias("late_rate"))
