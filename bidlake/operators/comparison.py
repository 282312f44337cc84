"""Scoring and ranking of competing quotations (DOM-8, DOM-9, DOM-17, DOM-27, AGG-12, WIN-1, WIN-7, JOIN-2, NEST-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Default weights and thresholds.
WEIGHTS = {"price": 0.40, "delivery": 0.20, "payment": 0.15, "reliability": 0.15, "other": 0.10}
MISSING, NEAR_TIE, LOW_COMPLETENESS, ASK_BELOW, TARGET_CUT = 0.35, 0.03, 0.8, 0.5, 0.05


def normal_weights(overrides: dict[str, float] | None = None) -> dict[str, float]:
    """NEST-5: merged, cut at 0 and scaled to 1; equal if all are 0. Unknown names dilute the known."""
    merged = {k: max(float(v), 0.0) for k, v in (WEIGHTS | (overrides or {})).items()}
    total = sum(merged.values())
    return {k: v / total if total else 1 / len(merged) for k, v in merged.items()}


def _scaled(value: Column, window, lower_is_better: bool) -> Column:
    """AGG-12: min-max score within the request; 1 where all are equal, a fixed score where missing."""
    low, high = F.min(value).over(window), F.max(value).over(window)
    part = F.when(high != low, (value - low) / F.when(high != low, high - low)).otherwise(0.0)
    score = F.when(high == low, 1.0).otherwise(1 - part if lower_is_better else part)
    return F.when(value.isNull(), MISSING).otherwise(score)


def compare(quotations: DataFrame, overrides: dict[str, float] | None = None) -> DataFrame:
    """DOM-8: one row per quotation with criterion scores, overall score and rank in its request.

    Needs request_id, quotation_id, landed, delivery_days, payment_days, reliability, coverage, error_count and
    warning_count. One exchange on the request serves all windows.
    """
    w = normal_weights(overrides)
    request = W.partitionBy("request_id")
    quality = F.greatest(F.lit(0.0), 1 - 0.25 * F.col("error_count") - 0.05 * F.col("warning_count"))
    scores = {
        "price": _scaled(F.col("landed"), request, True),
        "delivery": _scaled(F.col("delivery_days").cast("double"), request, True),
        "payment": _scaled(F.col("payment_days").cast("double"), request, False),
        "reliability": F.coalesce("reliability", F.lit(MISSING)),
        "other": 0.6 * F.coalesce("coverage", F.lit(MISSING)) + 0.4 * quality,
    }
    given = sum((F.col(c).isNotNull().cast("int") for c in ("landed", "delivery_days", "payment_days", "reliability", "coverage")), F.lit(0))
    scored = quotations.select("request_id", "quotation_id", "landed", *[s.alias(f"{k}_score") for k, s in scores.items()], (given / 5.0).alias("completeness"))
    overall = F.round(sum((F.round(F.col(f"{k}_score") * F.lit(w[k]), 4) for k in scores), F.lit(0.0)), 4)
    scored = scored.withColumn("overall", overall)
    place = request.orderBy(F.desc("overall"), F.desc("completeness"), F.asc_nulls_last("landed"), "quotation_id")
    gap = F.col("overall") - F.lead("overall").over(place)
    # WIN-7: a leader that is barely ahead is not decisive
    return scored.withColumn("rank", F.row_number().over(place)).withColumn("decisive", F.when(F.col("rank") == 1, F.coalesce(gap >= NEAR_TIE, F.lit(True))))


def explanation(compared: DataFrame) -> DataFrame:
    """DOM-9: criteria by weighted score, as text."""
    parts = F.array(*[F.struct((-F.col(f"{k}_score") * w).alias("key"), F.lit(k).alias("name")) for k, w in WEIGHTS.items()])
    return compared.withColumn("strengths", F.array_join(F.transform(F.array_sort(parts), lambda p: p["name"]), ", "))


def negotiation(compared: DataFrame) -> DataFrame:
    """DOM-17, DOM-27: target price, what to ask for and whether there is anything to negotiate."""
    asks = F.array_compact(F.array(*[F.when(F.col(f"{k}_score") < ASK_BELOW, F.lit(k)) for k in WEIGHTS]))
    return compared.select("request_id", "quotation_id", (F.col("landed") * (1 - TARGET_CUT)).alias("target"), F.array_join(asks, ",").alias("asks"), (F.size(asks) > 0).alias("negotiable"))
