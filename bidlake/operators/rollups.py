"""Roll-ups that take in new files alone (AGG-6 to AGG-9, AGG-28).

A roll-up keeps one partial state per source file and group: sums, counts, least and greatest values, which add up over
files. A refresh lists the source's files with their sizes and times, works out states for files that are new or have
changed, drops those of files that are gone, and leaves the others as they are; results are the states added up. So a
dashboard's cost follows what has come in since the last look, not the history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keyed import KeyedTable
from .aggregates import committed, rate

#: How a partial state is added up over files.
MERGES: dict[str, Callable[[str], Column]] = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
PARTS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


class RollUp:
    """Groups ``by`` (name -> expression) with ``parts`` (name -> (kind, expression); kinds sum, count, min, max) over the Parquet files
    of a folder. ``prepare`` maps the files' rows to those that count, row by row (filters, columns, explodes). States are stored
    in ``path``; ``buckets`` as in ``KeyedTable``."""

    def __init__(self, spark: SparkSession, source: str, path: str, by: dict[str, Column], parts: dict[str, tuple[str, Column]], prepare: Callable[[DataFrame], DataFrame] = lambda df: df, buckets: int = 16):
        self.spark, self.source, self.by, self.parts, self.prepare = spark, source, by, parts, prepare
        self.files = KeyedTable(spark, f"{path}/files", ["file"], buckets)
        self.states = KeyedTable(spark, f"{path}/states", ["file"], buckets)

    def listing(self) -> DataFrame:
        """(file, size, changed_at) of the source now; contents are not read."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(self.source)
        return found.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed_at"))

    def _partials(self, names: list[str]) -> DataFrame:
        rows = self.prepare(self.spark.read.parquet(*names).withColumn("_file", F.col("_metadata.file_path")))
        keys = [c.alias(k) for k, c in self.by.items()]
        return rows.groupBy(F.col("_file").alias("file"), *keys).agg(*[PARTS[kind](c).alias(name) for name, (kind, c) in self.parts.items()])

    def refresh(self) -> dict[str, int]:
        """Takes in what has changed; the numbers of files added (or read again) and dropped. Safe to run again after a crash: states
        are replaced by file before the list of files says that they are there."""
        now = self.listing().persist()
        try:
            first = self.files.state()["version"] == 0
            known = self.files.read() if not first else now.limit(0)
            new = now.join(known, ["file", "size", "changed_at"], "left_anti").select("file", "size", "changed_at")
            gone = known.join(now, "file", "left_anti").select("file", "size", "changed_at")
            fresh = [r.file for r in new.select("file").collect()]  # names of new files: what a listing of the folder holds too
            old = [r.file for r in gone.select("file").collect()]
            if fresh or old or first:
                touched = self.spark.createDataFrame([(f,) for f in fresh + old], "file string")
                added = self._partials(fresh) if fresh else None
                if first:
                    self.states.create(added if added is not None else self._no_states())
                else:
                    self._replace(self.states, touched, added)
                listed = new.where(F.col("file").isin(*fresh)) if fresh else now.limit(0)
                if first:
                    self.files.create(listed)
                else:
                    self._replace(self.files, touched, listed)
            return {"added": len(fresh), "dropped": len(old)}
        finally:
            now.unpersist()

    @staticmethod
    def _replace(table: KeyedTable, touched: DataFrame, added: DataFrame | None) -> None:
        def how(before: DataFrame) -> DataFrame:
            rest = before.join(touched, "file", "left_anti")
            return rest if added is None else rest.unionByName(added.select(*before.columns))

        table.merge(touched, how)

    def _no_states(self) -> DataFrame:
        raise ValueError(f"{self.source} holds no files")

    def result(self) -> DataFrame:
        """The states added up over files."""
        return self.states.read().groupBy(*self.by).agg(*[MERGES[kind](name).alias(name) for name, (kind, _) in self.parts.items()])


def spend_roll_up(spark: SparkSession, source: str, path: str) -> RollUp:
    """States of AGG-7, AGG-8 and AGG-6 over order files (supplier_id, total, status, on_time, created_at, ...) by supplier and month."""
    parts = {
        "spend": ("sum", F.col("total")), "orders": ("count", F.lit(1)), "delivered": ("count", F.col("on_time")),
        "on_time": ("count", F.when(F.col("on_time"), 1)), "updated_at": ("max", F.col("created_at")),
    }
    return RollUp(spark, source, path, {"supplier_id": F.col("supplier_id"), "month": F.date_format("created_at", "yyyy-MM")}, parts, committed)


def spend_by_supplier(states: DataFrame) -> DataFrame:
    """AGG-7 from states."""
    out = states.groupBy("supplier_id").agg(F.round(F.sum("spend"), 2).alias("spend"), *[F.sum(c).alias(c) for c in ("orders", "delivered", "on_time")])
    return out.withColumn("on_time_rate", rate(F.col("on_time"), F.col("delivered"))).orderBy(F.desc("spend"), "supplier_id")


def spend_by_month(states: DataFrame) -> DataFrame:
    """AGG-8 from states."""
    return states.groupBy("month").agg(F.round(F.sum("spend"), 2).alias("spend"))


def fingerprint(states: DataFrame) -> DataFrame:
    """AGG-6 from states: how many rows count, and the latest change."""
    return states.agg(F.coalesce(F.sum("orders"), F.lit(0)).alias("n"), F.max("updated_at").alias("updated_at"))


def item_roll_up(spark: SparkSession, source: str, path: str) -> RollUp:
    """States of AGG-9 over files of order lines (item, quantity, amount)."""
    return RollUp(spark, source, path, {"item": F.col("item")}, {"spend": ("sum", F.col("amount")), "quantity": ("sum", F.col("quantity"))})


def spend_by_item(states: DataFrame) -> DataFrame:
    """AGG-9 from states."""
    return states.select("item", F.round("spend", 2).alias("spend"), "quantity")
