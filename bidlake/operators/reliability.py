"""Rule-based supplier reliability and sourcing policy (DOM-12, DOM-22, DOM-23, DOM-29, DOM-30, AGG-24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.gstin import state_code, state_name

# Weights, and what a history needs to count in full or as clean.
WEIGHTS = {"profile": 0.30, "history": 0.25, "quality": 0.25, "responsiveness": 0.20}
FULL_HISTORY, MAX_CLEAN_WARNINGS, NEUTRAL, NEWEST = 5.0, 2, 0.5, 100
USABLE = ("COMPLETED", "REQUIRES_REVIEW")


def reliability(suppliers: DataFrame, quotations: DataFrame, newest: int = NEWEST) -> DataFrame:
    """DOM-12, DOM-29: score of each supplier from its profile and its ``newest`` quotations (the rule's own limit).

    suppliers: supplier_id, email, phone, gst_number, address. quotations: supplier_id, quotation_id, created_at,
    error_count, warning_count, processing_status.
    """
    recent = W.partitionBy("supplier_id").orderBy(F.desc("created_at"), F.desc("quotation_id"))
    q = quotations.withColumn("k", F.row_number().over(recent)).where(F.col("k") <= newest)
    clean = (F.coalesce("error_count", F.lit(0)) == 0) & (F.coalesce("warning_count", F.lit(0)) <= MAX_CLEAN_WARNINGS)
    sums = q.groupBy("supplier_id").agg(F.count("*").alias("n"), F.avg(clean.cast("int")).alias("quality"), F.avg(F.col("processing_status").isin(*USABLE).cast("int")).alias("usable"))
    present = sum((F.coalesce(F.col(c) != "", F.lit(False)).cast("int") for c in ("email", "phone", "gst_number", "address")), F.lit(0)) / 4.0
    n = F.coalesce("n", F.lit(0))
    score = (
        present * WEIGHTS["profile"] + F.least(n / FULL_HISTORY, F.lit(1.0)) * WEIGHTS["history"]
        + F.coalesce("quality", F.lit(NEUTRAL)) * WEIGHTS["quality"] + F.coalesce("usable", F.lit(NEUTRAL)) * WEIGHTS["responsiveness"]
    )
    return suppliers.join(sums, "supplier_id", "left").select("supplier_id", F.round(score, 4).alias("reliability"), n.cast("long").alias("sample_size"))


def next_actions(facts: DataFrame) -> DataFrame:
    """DOM-22: what may happen next, best first. Flags: has_rows, compared, recommended, risk_done, has_message,
    negotiable, message_approved, has_order, order_approved."""
    f = F.col
    action = (
        F.when(~f("has_rows"), F.when(f("compared"), "finish").otherwise("comparison"))
        .when(~f("recommended"), "recommendation,risk").when(~f("risk_done"), "risk,negotiation")
        .when(~f("has_message"), F.when(f("negotiable"), "negotiation,purchase_order").otherwise("purchase_order,negotiation"))
        .when(~f("message_approved"), "pause").when(~f("has_order"), "purchase_order").when(~f("order_approved"), "pause").otherwise("finish")
    )
    return facts.withColumn("next", action)


def autopilot(requests: DataFrame, quotations: DataFrame, runs: DataFrame, least: int = 2) -> DataFrame:
    """DOM-23: open requests with enough comparable quotations and no run under way."""
    enough = quotations.groupBy("request_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return requests.where("status = 'open'").join(enough, "request_id").join(runs, "request_id", "left_anti")


def organization_state(gstin: Column) -> Column:
    """DOM-30."""
    return F.struct(state_code(gstin).alias("state_code"), state_name(gstin).alias("state"))
