"""Matching of requested items and quoted lines, and of suppliers (DOM-7, JOIN-6, JOIN-8, WIN-8, AGG-14, JOIN-12, FN-20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.gstin import normalize_gstin
from ..functions.text import amounts_in, base_unit, email_key, normalize_text, similarity_bound, similarity_folded

# Fixed values.
AUTO, REVIEW, AMBIGUOUS_GAP, AMOUNT_TOLERANCE = 0.86, 0.62, 0.15, 0.5


def match_items(items: DataFrame, lines: DataFrame, blank_matches: bool = True) -> DataFrame:
    """DOM-7: best quoted line of each requested item: exact by normalised name, else fuzzy.

    items (request_id, request_item_id, name, unit), lines (request_id, quotation_id, line_id, name, unit). Exact pairs come from
    an equi-join; each of the rest is held against every line of the quotation, once per pair of distinct normalised names, on
    which alone the score depends, and scored unless a bound shows that it is neither best nor second (``score_pairs``). Without ``blank_matches``, names that fold to an empty text match nothing exactly, as in
    the purchasing flow. Lines are never used up; ties keep the first line; exact matches are not downgraded when
    units conflict.
    """
    a = items.select("request_id", "request_item_id", F.col("unit").alias("wanted_unit"), normalize_text("name").alias("key"))
    b = lines.select("request_id", "quotation_id", "line_id", F.col("unit").alias("offered_unit"), normalize_text("name").alias("key"))
    # of the lines with one name the first stands for all
    names = b.groupBy("request_id", "quotation_id", "key").agg(F.min("line_id").alias("line_id"), F.min_by("offered_unit", "line_id").alias("offered_unit"), F.count("*").alias("n"))
    pairs = items.select("request_id", "request_item_id").join(lines.select("request_id", "quotation_id").distinct(), "request_id")
    exact = (a if blank_matches else a.where("key <> ''")).join(names, ["request_id", "key"]).groupBy("request_item_id", "quotation_id").agg(F.min("line_id").alias("line_id"))
    exact = exact.select("*", F.lit(1.0).alias("score"), F.lit("exact").alias("method"), F.lit(None).cast("double").alias("gap"), F.lit(None).cast("boolean").alias("units_agree"))
    rest = a.join(pairs, ["request_id", "request_item_id"]).join(exact.select("request_item_id", "quotation_id"), ["request_item_id", "quotation_id"], "left_anti")
    wanted = rest.select("request_id", "quotation_id", F.col("key").alias("wanted")).distinct()
    scored = score_pairs(wanted.join(names.withColumnRenamed("key", "offered"), ["request_id", "quotation_id"])).where("score is not null")
    best = W.partitionBy("request_id", "quotation_id", "wanted").orderBy(F.desc("score"), "line_id")
    gap = F.when(F.col("n") > 1, F.lit(0.0)).otherwise(F.col("score") - F.lead("score").over(best))
    top = scored.withColumn("gap", gap).withColumn("k", F.row_number().over(best)).where("k = 1").withColumnRenamed("wanted", "key")
    agree = base_unit(F.col("wanted_unit")) == base_unit(F.col("offered_unit"))
    top = rest.join(top, ["request_id", "quotation_id", "key"]).select("request_item_id", "quotation_id", "line_id", "score", "gap", agree.alias("units_agree"))
    conflict = F.coalesce(~F.col("units_agree"), F.lit(False))
    method = F.when((F.col("score") >= AUTO) & ~conflict, "auto").when(F.col("score") >= REVIEW, "review").otherwise("unmatched")
    found = exact.unionByName(top.withColumn("method", method))
    out = pairs.join(found, ["request_item_id", "quotation_id"], "left")
    return out.withColumns({"method": F.coalesce("method", F.lit("unmatched")), "ambiguous": F.coalesce(F.col("gap") < AMBIGUOUS_GAP, F.lit(False))})


def score_pairs(pairs: DataFrame) -> DataFrame:
    """JOIN-6: ``bound`` and ``score`` of pairs (request_id, quotation_id, wanted, offered, ...) of folded names. The best two by bound of each
    wanted name are scored first; their lower score is a floor for the second best, and pairs whose bound lies under it keep
    a null score, as they can change neither the best nor the gap. Ties with the floor are scored."""
    group = W.partitionBy("request_id", "quotation_id", "wanted")
    ranked = pairs.withColumn("bound", similarity_bound("wanted", "offered"))
    ranked = ranked.withColumn("_r", F.row_number().over(group.orderBy(F.desc("bound"), "offered")))
    first = F.col("_r") <= 2
    probed = ranked.withColumn("_probe", similarity_folded(F.when(first, F.col("wanted")), F.when(first, F.col("offered"))))
    floored = probed.withColumn("_floor", F.min("_probe").over(group))
    open_ = ~first & (F.col("bound") >= F.col("_floor"))
    rest = similarity_folded(F.when(open_, F.col("wanted")), F.when(open_, F.col("offered")))
    return floored.withColumn("_rest", rest).withColumn("score", F.coalesce("_probe", "_rest")).drop("_r", "_probe", "_floor", "_rest")


def coverage(matches: DataFrame) -> DataFrame:
    """AGG-14: counts per quotation and the share of items matched or to be reviewed."""
    m = F.col("method")
    out = matches.groupBy("quotation_id").agg(
        F.count_if(m.isin("exact", "auto")).alias("matched"), F.count_if(m == "review").alias("review"), F.count_if(m == "unmatched").alias("unmatched"), F.count("*").alias("items")
    )
    return out.withColumn("coverage", F.try_divide(F.col("matched") + F.col("review"), F.col("items")))


def resolve_suppliers(quotes: DataFrame, suppliers: DataFrame) -> DataFrame:
    """JOIN-8: supplier of a quotation by GST number, else e-mail, else name, else normalised name; null means new.

    quotes (quote_id, gst_number, email, name), suppliers (supplier_id, gst_number, email, name). Of several suppliers
    with the same key the smallest id wins.
    """
    keys = {
        "gst": lambda d: normalize_gstin(d["gst_number"]), "email": lambda d: email_key(d["email"]), "name": lambda d: F.lower(F.trim(d["name"])),
        "folded": lambda d: normalize_text(d["name"]),
    }
    out = quotes
    for k, key in keys.items():
        side = suppliers.select(key(suppliers).alias(f"_{k}"), "supplier_id").where(F.coalesce(F.col(f"_{k}"), F.lit("")) != "")
        side = side.groupBy(f"_{k}").agg(F.min("supplier_id").alias(f"_id_{k}"))
        out = out.withColumn(f"_{k}", key(out)).join(side, f"_{k}", "left").drop(f"_{k}")
    resolved = F.coalesce(*[F.col(f"_id_{k}") for k in keys])
    how = F.coalesce(*[F.when(F.col(f"_id_{k}").isNotNull(), F.lit(k)) for k in keys])
    return out.select(*quotes.columns, resolved.alias("supplier_id"), F.coalesce(how, F.lit("new")).alias("matched_by"))


def guardrail(messages: DataFrame, rows: DataFrame) -> DataFrame:
    """JOIN-12, FN-20: messages (message_id, request_id, recipient, body) that name a competitor or state its amount."""
    other = rows.select("request_id", F.col("name").alias("competitor"), F.col("amounts"))
    pairs = messages.join(other, "request_id").where(F.col("recipient") != F.col("competitor"))
    names = F.lower("body").contains(F.lower("competitor"))
    states = F.exists(amounts_in(F.col("body")), lambda a: F.exists("amounts", lambda b: F.abs(a - b) <= AMOUNT_TOLERANCE))
    return pairs.select("message_id", "competitor", names.alias("names"), states.alias("states")).where("names or states")
