"""Calendars, monthly series and the demand forecast (TS-1…8, AGG-3, AGG-19, DOM-18, WIN-10, FN-23)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import smape_term

SEASON, MIN_MONTHS, MAX_HOLDOUT = 12, 12, 6


def daily_counts(events: DataFrame, stamp: str, as_of: str, days: int = 14) -> DataFrame:
    """AGG-3, TS-1: count per day of the last ``days`` days up to the instant ``as_of``, empty days as 0."""
    now = F.lit(as_of).cast("timestamp_ntz")
    start = now - F.expr(f"INTERVAL {days - 1} DAYS")
    counted = events.where(F.col(stamp) >= start).groupBy(F.date_format(stamp, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("c"))
    calendar = events.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(start), F.to_date(now))).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    return calendar.join(counted, "day", "left").select("day", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def monthly_series(df: DataFrame, item: str, stamp: str, quantity: str) -> DataFrame:
    """AGG-19, TS-2: summed quantity per item and month from its first to its last, empty months as 0."""
    rows = df.where(F.col(stamp).isNotNull() & F.col(quantity).isNotNull())
    sums = rows.groupBy(F.col(item).alias("item"), F.trunc(F.col(stamp).cast("date"), "month").alias("month")).agg(F.sum(quantity).alias("quantity"))
    span = sums.groupBy("item").agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return span.join(sums, ["item", "month"], "left").select("item", "month", F.coalesce("quantity", F.lit(0.0)).alias("quantity"))


def backtest(series: DataFrame) -> DataFrame:
    """DOM-18, TS-3…6: per item, sMAPE of both methods on the held-out months, the better method and the
    number of months; items with too few are ``insufficient_data``. Ties go to the seasonal method."""
    order = W.partitionBy("item").orderBy("month")
    rows = series.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(W.partitionBy("item")))
    hold = F.least(F.lit(MAX_HOLDOUT), F.floor(F.col("n") / 4))
    rows = rows.withColumn("h", hold.cast("long")).withColumn("train", F.col("i") < F.col("n") - hold)
    y, i = F.when(F.col("train"), F.col("quantity")), F.when(F.col("train"), F.col("i").cast("double"))
    item = W.partitionBy("item")
    slope, start = F.regr_slope(y, i).over(item), F.regr_intercept(y, i).over(item)
    rows = rows.select("item", "i", "n", "h", "train", "quantity", slope.alias("slope"), start.alias("start"))
    # the seasonal value of a held-out month is that of the last same month in the training part
    back = (F.floor((F.col("i") - (F.col("n") - F.col("h"))) / SEASON) + 1).cast("long") * SEASON
    held = rows.where("not train").withColumn("from", F.col("i") - back)
    past = rows.select("item", F.col("i").alias("from"), F.col("quantity").alias("seasonal"))
    linear = F.greatest(F.col("start") + F.col("slope") * F.col("i"), F.lit(0.0))
    scored = held.join(past, ["item", "from"], "left").groupBy("item").agg(
        F.max("n").alias("months"), F.max("h").alias("holdout"), F.avg(smape_term(F.col("quantity"), linear)).alias("linear_smape"),
        F.avg(F.when(F.col("n") >= SEASON + F.col("h"), smape_term(F.col("quantity"), F.greatest("seasonal", F.lit(0.0))))).alias("seasonal_smape"),
    )
    every = series.groupBy("item").agg(F.count("*").alias("months"))
    joined = every.join(scored.drop("months"), "item", "left")
    enough = F.col("months") >= MIN_MONTHS
    method = F.when(~enough, None).when(F.col("seasonal_smape") <= F.col("linear_smape"), "seasonal_naive").otherwise("linear_trend")
    return joined.select(
        "item", "months", F.when(enough, "ok").otherwise("insufficient_data").alias("status"), method.alias("method"),
        F.when(enough, F.col("linear_smape")).alias("linear_smape"), F.when(enough, F.col("seasonal_smape")).alias("seasonal_smape"),
    )


def clamped_horizon(horizon: int) -> int:
    """TS-7: a wanted horizon held to 1…12 months."""
    return min(max(horizon, 1), 12)


def forecast(series: DataFrame, horizon: int = 3) -> DataFrame:
    """DOM-18: the next months of every item by its better method, refitted on all months; never below 0."""
    if not 1 <= horizon <= 12:
        raise ValueError("the horizon is 1 to 12 months; see clamped_horizon")
    chosen = backtest(series).where("status = 'ok'").select("item", "method", "months")
    order = W.partitionBy("item").orderBy("month")
    rows = series.withColumn("i", (F.row_number().over(order) - 1).cast("double"))
    fit = rows.groupBy("item").agg(F.regr_slope("quantity", "i").alias("slope"), F.regr_intercept("quantity", "i").alias("start"), F.max("month").alias("last"))
    steps = chosen.join(fit, "item").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    steps = steps.withColumn("from", (F.col("months") - SEASON + (F.col("step") - 1) % SEASON).cast("double"))
    past = rows.select("item", F.col("i").alias("from"), F.col("quantity").alias("seasonal"))
    linear = F.col("start") + F.col("slope") * (F.col("months") + F.col("step") - 1)
    value = F.greatest(F.when(F.col("method") == "linear_trend", linear).otherwise(F.col("seasonal")), F.lit(0.0))
    return steps.join(past, ["item", "from"], "left").select("item", F.date_format(F.add_months("last", F.col("step")), "yyyy-MM").alias("month"), "method", value.alias("quantity"))


def zero_months(series: DataFrame) -> DataFrame:
    """TS-8: months, months without demand, first and last month of each group."""
    return series.groupBy("item").agg(
        F.count("*").alias("months"), F.count_if(F.col("quantity") == 0).alias("zero_months"), F.date_format(F.min("month"), "yyyy-MM").alias("first_month"),
        F.date_format(F.max("month"), "yyyy-MM").alias("last_month"),
    )
