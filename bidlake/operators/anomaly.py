"""Price anomalies (DOM-10, DOM-11, DOM-25, AGG-16, AGG-20, WIN-6, TOP-5, ML-15)."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import positive_finite

# Thresholds of the ladder and of the fence, and the order of severity.
RATIO_POSSIBLE, RATIO_HIGH, Z_POSSIBLE, Z_HIGH, MIN_FOR_Z = 0.35, 0.60, 2.0, 3.0, 3
FENCE_POSSIBLE, FENCE_HIGH, MIN_FOREST, ZERO_SPREAD = 1.5, 3.0, 20, 0.01
SEVERITY = {"HIGH_ANOMALY": 3, "POSSIBLE_ANOMALY": 2, "NORMAL": 1, "INSUFFICIENT_DATA": 0}
TREES, SEED, SAMPLE = 200, 42, 256
#: SRC-8: newest prices of an item that are looked at.
NEWEST_PRICES = 1000
#: Candidates of an item that one task scores.
CANDIDATES = 100_000


def ladder(prices: DataFrame, mean="mean", stddev="stddev", n="n", price="unit_price") -> DataFrame:
    """DOM-10: status of each price by the statistics of its history; thresholds are inclusive."""
    p, m, s, k = (F.col(c) for c in (price, mean, stddev, n))
    ratio = (p - m) / F.when(m != 0, m)
    by_ratio = F.when(F.abs(ratio) >= RATIO_HIGH, "HIGH_ANOMALY").when(F.abs(ratio) >= RATIO_POSSIBLE, "POSSIBLE_ANOMALY").otherwise("NORMAL")
    z = F.abs(p - m) / F.when(s != 0, s)
    by_z = F.when(z >= Z_HIGH, "HIGH_ANOMALY").when(z >= Z_POSSIBLE, "POSSIBLE_ANOMALY").otherwise("NORMAL")
    known = p.isNotNull() & (F.coalesce(k, F.lit(0)) > 0)
    use_z = (k >= MIN_FOR_Z) & (F.coalesce(s, F.lit(0.0)) != 0)
    return prices.withColumns({
        "status": F.when(~known, "INSUFFICIENT_DATA").when(use_z, by_z).otherwise(by_ratio),
        "method": F.when(~known, "none").when(use_z, "z_score").otherwise("ratio"),
        "mean_deviation": ratio,
    })


def leave_one_out(history: DataFrame) -> DataFrame:
    """WIN-6: each price with mean and count of all the others of its item."""
    item = W.partitionBy("item")
    n, total = F.count("unit_price").over(item), F.sum("unit_price").over(item)
    return history.withColumn("others", n - 1).withColumn("others_mean", F.try_divide(total - F.col("unit_price"), n - 1))


def fence(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """DOM-25 and the exact branches of DOM-11: log price against the range of the item's positive prices, in
    interquartile ranges beyond the nearest end; the whole range where those are 0."""
    good = history.where(positive_finite(F.col("unit_price")))
    med = good.groupBy("item").agg(F.percentile("unit_price", 0.5).alias("median"), F.count("*").alias("n"))
    logs = good.join(med, "item").withColumn("x", F.ln(F.col("unit_price") / F.col("median")))
    q = logs.groupBy("item", "median", "n").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.percentile("x", 0.25).alias("q1"), F.percentile("x", 0.75).alias("q3"))
    c = candidates.where(positive_finite(F.col("price"))).join(q.where(F.col("n") >= MIN_FOREST), "item")
    x = F.ln(F.col("price") / F.col("median"))
    spread = F.when(F.col("q3") != F.col("q1"), F.col("q3") - F.col("q1")).otherwise(F.col("hi") - F.col("lo"))
    beyond = F.try_divide(F.greatest(F.col("lo") - x, x - F.col("hi"), F.lit(0.0)), spread)
    flat = F.col("hi") == F.col("lo")
    status = (
        F.when(flat & (F.abs(F.col("price") / F.col("median") - 1) > ZERO_SPREAD), "POSSIBLE_ANOMALY").when(flat, "NORMAL")
        .when(beyond >= FENCE_HIGH, "HIGH_ANOMALY").when(beyond >= FENCE_POSSIBLE, "POSSIBLE_ANOMALY")
    )
    return c.select("item", "price", "n", "median", (F.col("price") / F.col("median")).alias("median_ratio"), beyond.alias("beyond"), status.alias("status"))


class Forest:
    """Isolation forest over one number: the fewer random cuts part a value from the sample, the odder."""

    def __init__(self, values: np.ndarray, trees: int = TREES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(SAMPLE, len(values))
        self.depth = int(np.ceil(np.log2(max(self.size, 2))))
        self.trees = []
        for _ in range(trees):
            x = np.sort(rng.choice(values, self.size, replace=False)).tolist()
            cuts: list[float] = []
            depths: list[float] = []
            self._grow(x, 0, len(x), 0, rng, cuts, depths)
            self.trees.append((np.array(cuts), np.array(depths)))

    @staticmethod
    def _rest(n: int) -> float:
        """Expected further cuts among n equal-ranking values."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, x: list, i: int, j: int, depth: int, rng, cuts: list, depths: list) -> None:
        """Cuts in ascending order and the path lengths of the intervals between them."""
        if depth >= self.depth or j - i < 2 or x[i] == x[j - 1]:
            depths.append(depth + self._rest(j - i))
            return
        cut = x[i] + rng.random() * (x[j - 1] - x[i])
        m = bisect_left(x, cut, i, j)
        self._grow(x, i, m, depth + 1, rng, cuts, depths)
        cuts.append(cut)
        self._grow(x, m, j, depth + 1, rng, cuts, depths)

    def score(self, x: np.ndarray) -> np.ndarray:
        """From -1 (odd) to 0 (ordinary)."""
        total = sum(depths[np.searchsorted(cuts, x, side="right")] for cuts, depths in self.trees)
        return -(2.0 ** (-total / len(self.trees) / max(self._rest(self.size), 1e-9)))


def assess_all(prices: np.ndarray, history: np.ndarray) -> pd.DataFrame:
    """DOM-11: status, score and ratio of each price, by one forest; null below 20 positive prices in the history and for prices
    that are not positive. Branches: no spread, fence, 2 %, 10 %. The order of the history does not matter."""
    p = np.asarray(prices, dtype=float)
    h = np.asarray(history, dtype=float)
    h = np.sort(h[np.isfinite(h) & (h > 0)])
    out = pd.DataFrame({"status": pd.Series([None] * len(p), dtype=object), "score": np.nan, "ratio": np.nan})
    good = np.flatnonzero(np.isfinite(p) & (p > 0))
    if len(h) < MIN_FOREST or not len(good):
        return out
    median = float(np.median(h))
    ratio = p[good] / median
    past, x = np.log(h / median), np.log(ratio)
    if np.ptp(past) == 0:
        status, score = np.where(np.abs(ratio - 1) > ZERO_SPREAD, "POSSIBLE_ANOMALY", "NORMAL"), np.zeros(len(good))
    else:
        q1, q3 = np.percentile(past, [25, 75])
        beyond = np.maximum(np.maximum(past.min() - x, x - past.max()), 0.0) / ((q3 - q1) or np.ptp(past))
        forest = Forest(past)
        score = forest.score(x)
        low, mid = np.percentile(forest.score(past), [2, 10])
        status = np.where(score < low, "HIGH_ANOMALY", np.where(score < mid, "POSSIBLE_ANOMALY", "NORMAL"))
        status = np.where(beyond >= FENCE_HIGH, "HIGH_ANOMALY", np.where(beyond >= FENCE_POSSIBLE, "POSSIBLE_ANOMALY", status))
    out.loc[good, "status"], out.loc[good, "score"], out.loc[good, "ratio"] = status, score, ratio
    return out


def assess(price: float, history: np.ndarray) -> dict | None:
    """DOM-11 on one price; null where it has no status."""
    row = assess_all(np.array([np.nan if price is None else price]), history).iloc[0]
    return None if row.status is None else row.to_dict()


def forest_status(candidates: DataFrame, history: DataFrame, max_history: int = NEWEST_PRICES, chunk: int = CANDIDATES) -> DataFrame:
    """DOM-11, SRC-8: candidates (item, price) against the newest ``max_history`` prices of their item, a limit
    of the operator itself, which also bounds the history that a task holds.

    One forest is grown for an item and scores all its candidates at once; an item of more than ``chunk`` candidates is dealt out, and
    its forest, which is the same for the same history, grown in each share. Items without history have no row; a price that is no number comes back as null.
    """
    newest = W.partitionBy("item").orderBy(F.desc("created_at"), "unit_price")
    recent = history.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= max_history)
    listed = recent.groupBy("item").agg(F.collect_list("unit_price").alias("past"))
    shares = candidates.groupBy("item").agg(F.ceil(F.count("*") / chunk).cast("int").alias("shares"))
    past = listed.join(shares, "item").select("item", "past", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    dealt = candidates.select("item", F.col("price").cast("double").alias("price")).join(shares, "item").select("item", "price", F.pmod(F.xxhash64("price", F.monotonically_increasing_id()), "shares").cast("int").alias("share"))

    def judged(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(others):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("item", "price", "status", "score", "ratio")})
        prices = mine["price"].to_numpy(dtype=float)
        out = assess_all(prices, others["past"].iloc[0])
        plain = lambda c: pd.Series(list(out[c]), dtype=object if c == "status" else float)
        return pd.DataFrame({"item": pd.Series(mine["item"].tolist(), dtype=object), "price": prices, **{c: plain(c) for c in out.columns}})

    item = candidates.schema["item"].dataType.simpleString()
    pairs = dealt.groupBy("item", "share").cogroup(past.groupBy("item", "share"))
    out = pairs.applyInPandas(judged, f"item {item}, price double, status string, score double, ratio double")
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("item", known("price"), "status", known("score"), known("ratio"))


def worst_status(df: DataFrame, key: str) -> DataFrame:
    """AGG-16: the gravest status of each key."""
    rank = F.create_map(*[F.lit(x) for p in SEVERITY.items() for x in p])
    return df.groupBy(key).agg(F.max_by("status", rank[F.col("status")]).alias("worst"))


def status_shares(df: DataFrame) -> DataFrame:
    """AGG-20: prices, median and share of each flag per item."""
    flag = lambda s: F.avg((F.col("status") == s).cast("int"))
    return df.groupBy("item").agg(F.count("*").alias("prices"), F.median("unit_price").alias("median"), flag("POSSIBLE_ANOMALY").alias("possible"), flag("HIGH_ANOMALY").alias("high"))
