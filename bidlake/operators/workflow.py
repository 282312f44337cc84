"""Guards, texts and small projections of the purchasing flow (FIL-7, FIL-8, FIL-11, FIL-13, JOIN-11, PRJ-4, PRJ-7, TOP-6…8, NEST-1, NEST-3, AGG-28)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.gstin import normalize_gstin
from ..sources.scans import IN_PROGRESS

# Fixed values.
NOT_COMPLETE = ("FAILED", *IN_PROGRESS)
WEAK_SCORE = 0.5
MAX_TABLE_ROWS, MAX_PROMPT, MAX_OUTPUT = 200, 60_000, 12_000
CACHE_ENTRIES = 256


def with_readiness(quotations: DataFrame, status: str = "processing_status") -> DataFrame:
    """FIL-7: ``excluded_reason``, null for quotations that can be compared."""
    s = F.col(status)
    return quotations.withColumn("excluded_reason", F.when(s.isin(*NOT_COMPLETE), F.concat(F.lit("Processing is not complete (status "), s, F.lit(")."))))


def allow_listed(rows: DataFrame, ids: list | None, key: str = "quotation_id") -> DataFrame:
    """FIL-8: only the listed ids; no list lets all pass."""
    return rows.where(F.col(key).isin(*ids)) if ids else rows


def uniqueness_conflicts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """FIL-11: ``conflict`` of each new supplier (name, gst_number): a name, in any case, or a GST number that is stored; the name counts first."""
    names = existing.select(F.lower("name").alias("_n")).where("_n is not null").distinct().withColumn("_by_name", F.lit(True))
    numbers = existing.select(normalize_gstin(F.col("gst_number")).alias("_g")).where("_g is not null").distinct().withColumn("_by_gst", F.lit(True))
    found = new.join(names, F.lower("name") == F.col("_n"), "left").join(numbers, normalize_gstin(F.col("gst_number")) == F.col("_g"), "left")
    said = F.when(F.col("_by_name"), F.concat(F.lit("A supplier named '"), "name", F.lit("' already exists.")))
    return found.withColumn("conflict", F.coalesce(said, F.when(F.col("_by_gst"), F.concat(F.lit("A supplier with GST "), "gst_number", F.lit(" already exists."))))).drop("_n", "_g", "_by_name", "_by_gst")


def award_guard(awards: DataFrame, quotations: DataFrame, priced: DataFrame, key: Sequence[str] = ("quotation_id",)) -> DataFrame:
    """FIL-13: ``error`` of each award (request_id, *key): the quotation must be known, belong to the request
    and have a line in ``priced`` (*key of order lines). ``key`` names one quotation."""
    q = quotations.select(*key, F.col("request_id").alias("_of"))
    lines = priced.select(*key).distinct().withColumn("_priced", F.lit(True))
    error = (
        F.when(F.col("_of").isNull(), "Quotation not found.").when(F.col("_of") != F.col("request_id"), "That quotation belongs to a different request.")
        .when(F.col("_priced").isNull(), "No request item is matched and priced in this quotation.")
    )
    return awards.join(q, [*key], "left").join(lines, [*key], "left").withColumn("error", error).drop("_of", "_priced")


def comparison_row(quotations: DataFrame, comparison: DataFrame, key: Sequence[str] = ("quotation_id",)) -> DataFrame:
    """JOIN-11: each quotation with its row of the comparison. ``key`` names one quotation."""
    return quotations.join(comparison, [*key])


def explode_lines(orders: DataFrame, lines: str = "lines") -> DataFrame:
    """NEST-1: one row per line, its fields beside the order's; ``line`` counts from 1."""
    rest = [c for c in orders.columns if c != lines]
    return orders.select(*rest, F.posexplode(lines).alias("line", "_x")).select(*rest, (F.col("line") + 1).alias("line"), "_x.*")


def append_all(rows: DataFrame, entries: DataFrame, key: str, into: str) -> DataFrame:
    """NEST-3: ``entries`` (key, at, and the fields of ``into``'s records) put at the end of each row's array in their order."""
    fields = rows.schema[into].dataType.elementType.names
    new = entries.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.struct(*fields).alias("e")))).alias("_new"))
    kind = rows.schema[into].dataType
    added = F.transform("_new", lambda x: x["e"]).cast(kind)
    none = F.array().cast(kind)
    return rows.join(new, key, "left").withColumn(into, F.concat(F.coalesce(into, none), F.coalesce(added, none))).drop("_new")


def recent_messages(messages: DataFrame, n: int = 5, kinds: tuple[str, ...] = ("negotiation", "rfq")) -> DataFrame:
    """TOP-8: the newest ``n`` messages of these kinds to each supplier."""
    w = W.partitionBy("supplier_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    return messages.where(F.col("kind").isin(*kinds)).withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def failures_last(rows: DataFrame, position: str, status: str = "status") -> DataFrame:
    """TOP-6: rows that are not ok go last; otherwise the order they came in."""
    return rows.orderBy(F.when(F.col(status) == "ok", 0).otherwise(1), position)


def shorten(c: Column, most: int = MAX_OUTPUT) -> Column:
    """TOP-7: a text cut to ``most`` characters, with a mark if it was longer."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("\n...[truncated]"))).otherwise(c)


def prompt_text(raw: Column, tables: Column, most: int = MAX_PROMPT) -> Column:
    """TOP-7: text and tables (array of name, page, headers, rows) as one block; 200 rows a table, ``most`` characters in all."""
    head = F.when(F.trim(raw) != "", F.concat(F.lit("===== DOCUMENT TEXT =====\n"), F.trim(raw)))
    cells = lambda xs: F.array_join(F.transform(xs, lambda c: F.coalesce(c, F.lit(""))), " | ")

    def table(t: Column, i: Column) -> Column:
        label = F.coalesce(t["name"], F.concat(F.lit("Table "), (i + 1).cast("string")))
        page = F.coalesce(F.concat(F.lit(" (page "), t["page"].cast("string"), F.lit(")")), F.lit(""))
        columns = F.when(F.size(t["headers"]) > 0, F.concat(cells(t["headers"]), F.lit("\n" + "-" * 40)))
        rows = F.slice(t["rows"], 1, MAX_TABLE_ROWS)
        return F.concat_ws("\n", F.concat(F.lit("\n===== TABLE: "), label, page, F.lit(" =====")), columns, F.when(F.size(rows) > 0, F.array_join(F.transform(rows, cells), "\n")))

    return shorten(F.concat_ws("\n", head, F.when(F.size(tables) > 0, F.array_join(F.transform(tables, table), "\n"))), most)


def slim(*columns: str) -> Column:
    """PRJ-4: the columns as JSON without what is null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def _plain(c: Column) -> Column:
    """A quantity without trailing zeros."""
    return F.when(c.isNotNull(), F.regexp_replace(F.regexp_replace(F.format_string("%.4f", c), "0+$", ""), r"\.$", ""))


def rfq_text(items: Column, supplier: Column, buyer: Column, contact: Column, required_by: Column) -> Column:
    """PRJ-7: the body of a request for quotation; ``items`` have name, quantity, unit and specifications."""

    def line(x: Column, i: Column) -> Column:
        amount = F.coalesce(F.trim(F.concat(_plain(x["quantity"]), F.lit(" "), F.coalesce(x["unit"], F.lit("")))), F.lit("quantity to be confirmed"))
        return F.concat((i + 1).cast("string"), F.lit(". "), x["name"], F.lit(": "), amount, F.coalesce(F.concat(F.lit(" - "), x["specifications"]), F.lit("")))

    when = F.coalesce(F.concat(F.lit("\nRequired by: "), F.date_format(required_by, "dd MMM yyyy")), F.lit(""))
    return F.trim(F.concat(
        F.lit("Dear "), F.coalesce(supplier, F.lit("Sir/Madam")), F.lit(",\n\n"), F.coalesce(buyer, F.lit("We")), F.lit(" invites your quotation for the following:\n\n"),
        F.array_join(F.transform(items, line), "\n"), F.lit("\n"), when,
        F.lit("\n\nPlease include unit prices, GST, freight, delivery time and payment terms, and reply to this email with your quotation (PDF or Excel).\n\nRegards,\n"),
        F.coalesce(buyer, F.lit("")), F.lit("\n"), F.coalesce(contact, F.lit("")),
    ))


def negotiation_asks(target: Column, delivery_score: Column, delivery_days: Column, payment_score: Column, payment_days: Column) -> Column:
    """PRJ-7: what a supplier is asked for: a lower total, and better terms where a criterion scores under one half."""
    weak = lambda s: F.coalesce(s, F.lit(1.0)) < WEAK_SCORE
    known = lambda d, said, other: F.when(d != 0, F.concat(F.lit(said[0]), d.cast("string"), F.lit(said[1]))).otherwise(F.lit(other))
    faster = known(delivery_days, ("faster delivery than ", " days"), "faster delivery")
    credit = known(payment_days, ("a longer credit period than ", " days"), "some credit instead of advance payment")
    return F.array_compact(F.array(
        F.concat(F.lit("a revised total of INR "), F.format_number(target, 2)), F.when(weak(delivery_score), faster), F.when(weak(payment_score), credit),
    ))


def negotiation_text(supplier: Column, title: Column, asks: Column, buyer: Column) -> Column:
    """PRJ-7: the body of a negotiation message."""
    return F.concat(
        F.lit("Dear "), supplier, F.lit(",\n\nThank you for your quotation for "), title, F.lit(". We would like to proceed, and ask you to consider:\n\n"),
        F.array_join(F.transform(asks, lambda a: F.concat(F.lit("- "), a)), "\n"), F.lit("\n\nWe look forward to your revised offer.\n\nRegards,\n"), F.coalesce(buyer, F.lit("")),
    )


class ResultCache:
    """AGG-28: small results by name, tenant and version of the sources (AGG-6); worked out anew when the version changes.
    All entries go when there are ``CACHE_ENTRIES``."""

    def __init__(self):
        self._held: dict[tuple, object] = {}

    def get(self, name: str, organization_id: str, fingerprint: DataFrame, compute: Callable[[], object]) -> object:
        """``fingerprint`` is a row a source (aggregates.fingerprint); ``compute`` gives what a driver may hold."""
        version = tuple(sorted(str(r) for r in fingerprint.collect()))  # a row a source
        key = (name, organization_id, version)
        if key not in self._held:
            if len(self._held) >= CACHE_ENTRIES:
                self._held.clear()
            self._held[key] = compute()
        return self._held[key]
