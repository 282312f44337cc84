"""Tenant views, scans and pages (ISO-1, SRC-1…8, SRC-22…24, FIL-1…6, FIL-10, PRJ-1, PRJ-2, PRJ-5, TOP-1, TOP-2, AGG-27)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MAX_PAGE = 500
HEAVY = ("raw_content", "ocr_result", "ai_extraction", "history")
IN_PROGRESS = ("UPLOADED", "QUEUED", "EXTRACTING", "AI_EXTRACTING", "NORMALIZING")


class TenantView:
    """ISO-1: the only way to a tenant's rows; every frame it gives out is filtered by the organisation."""

    def __init__(self, tables: dict[str, DataFrame], organization_id: str):
        if not organization_id:
            raise ValueError("an organisation is needed")
        self._tables, self._org = tables, organization_id

    def table(self, name: str) -> DataFrame:
        return self._tables[name].where(F.col("organization_id") == self._org)

    def list(self, name: str, filters: dict | None = None, sort: str = "created_at", descending: bool = True, skip: int = 0, limit: int = 50, tie: str = "id") -> DataFrame:
        """SRC-1, TOP-1, TOP-2: a page; the limit is held to 1…500. Equal values of ``sort`` follow ``tie``, so pages are stable."""
        order = F.desc(sort) if descending else F.asc(sort)
        return where_all(self.table(name), filters).orderBy(order, tie).offset(max(skip, 0)).limit(min(max(limit, 1), MAX_PAGE))

    def get(self, name: str, key: str) -> DataFrame:
        """SRC-2."""
        return self.table(name).where(F.col("id") == key).limit(1)

    def find_all(self, name: str, filters: dict | None = None, fields: list[str] | None = None) -> DataFrame:
        """SRC-3: unbounded, pruned to ``fields``, else without ``history``."""
        rows = where_all(self.table(name), filters)
        return rows.select(*fields) if fields else rows.drop("history")

    def quotations(self, status: str | None = None, request_id=None, supplier_id=None) -> DataFrame:
        """SRC-4: quotations by what is supplied, without heavy columns."""
        return where_all(self.table("quotations"), {"processing_status": status, "request_id": request_id, "supplier_id": supplier_id}).drop(*HEAVY)

    def for_request(self, request_id, limit: int = MAX_PAGE) -> DataFrame:
        """SRC-5: quotations of one request, the first 500 by id."""
        return self.table("quotations").where(F.col("request_id") == request_id).orderBy("id").limit(limit)

    def latest(self, name: str, key: str, value) -> DataFrame:
        """SRC-22: the last stored row of a key (the comparison of a request, the connection of a provider)."""
        return self.table(name).where(F.col(key) == value).orderBy(F.desc("updated_at"), F.desc("id")).limit(1)

    def supplier_names(self) -> DataFrame:
        """SRC-23: ids and names, uncapped, so that no supplier is created twice."""
        return self.table("suppliers").select("id", "name")

    def name_search(self, name: str, part: str, fetched: int = 50, shown: int = 25) -> DataFrame:
        """FIL-10: the first 25 names that hold a text, of the 50 newest rows."""
        return self.list(name, limit=fetched).where(name_contains(F.col("name"), part)).limit(shown)

    def count(self, name: str, filters: dict | None = None) -> DataFrame:
        """AGG-27."""
        return where_all(self.table(name), filters).agg(F.count("*").alias("n"))


def where_all(df: DataFrame, filters: dict | None) -> DataFrame:
    """FIL-1, FIL-2: equality for each supplied value, IN for lists; absent values do not filter."""
    tests = [F.col(k).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in (filters or {}).items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def name_equals(c: Column, name: str) -> Column:
    """FIL-4."""
    return F.lower(c) == name.lower()


def name_contains(c: Column, part: str) -> Column:
    """FIL-5, FIL-10: literal, any case."""
    return F.contains(F.lower(c), F.lit(part.lower()))


def pending(quotations: DataFrame, limit: int | None = None) -> DataFrame:
    """SRC-7: rows in progress of all tenants; a privileged scan that bypasses the view."""
    rows = quotations.where(F.col("processing_status").isin(*IN_PROGRESS))
    return rows.limit(limit) if limit else rows


def connected_channels(channels: DataFrame, limit: int = 1000) -> DataFrame:
    """SRC-24: connected channels of all tenants, 1000 at most; a privileged scan."""
    return channels.where(F.col("status") == "connected").orderBy("id").limit(limit)


def newest_per(df: DataFrame, key: str, order: str, n: int, tie: str) -> DataFrame:
    """SRC-8: the newest ``n`` rows of each key."""
    w = W.partitionBy(key).orderBy(F.desc(order), tie)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def unseen(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """SRC-6: rows whose channel reference is not stored yet."""
    return incoming.join(stored.select(key), key, "left_anti")


def set_path(df: DataFrame, column: str, path: str, value: Column) -> DataFrame:
    """PRJ-5: replace a nested field by its dotted path; an unknown path is an error."""
    node = df.schema[column].dataType
    for part in path.split("."):
        names = getattr(node, "names", [])
        if part not in names:
            raise ValueError(f"no field {part!r} in {column}.{path}")
        node = node[part].dataType
    return df.withColumn(column, F.col(column).withField(path, value))
