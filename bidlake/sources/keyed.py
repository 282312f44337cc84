"""A table kept by key: merges rewrite only the buckets that they touch, and batches of streams count once (SNK-2, SNK-3, SNK-7, SNK-10, SNK-11, STR-2).

Rows lie in folders by the hash of their key. Every write puts its files into a folder of its own, which nobody reads,
and becomes part of the table by one small file, ``_commits/<number>.json``, that says which folders
each bucket now consists of. Its rename fails if the number is taken, so of two writers one comes second; that
one goes on if the other touched no bucket of its own, else it works again on what is there now. A writer that dies leaves
an unread folder and no harm.

The commit file also holds the last batch of each stream, so a batch that is run again is known. Keys are claimed
against the rows of their buckets, not of the batch, so that a new checkpoint or a second job adds no key twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders of a bucket beyond which the next insert writes it anew, commit files kept, and attempts of a writer.
FOLDERS, KEPT, ATTEMPTS = 8, 50, 20


class KeyedTable:
    """``keys`` name the rows (no two rows share them). Choose ``buckets`` for buckets of some hundred megabytes; it is fixed once written."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    # --- commits ---

    def _hadoop(self):
        jvm = self.spark._jvm.org.apache.hadoop.fs
        conf = self.spark._jsc.hadoopConfiguration()
        folder = jvm.Path(f"{self.path}/_commits")
        return jvm, folder.getFileSystem(conf), jvm.FileContext.getFileContext(folder.toUri(), conf), folder

    def _versions(self) -> list[int]:
        _, fs, _, folder = self._hadoop()
        if not fs.exists(folder):
            return []
        return sorted(int(n[:-5]) for s in fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit())

    def state(self) -> dict:
        """The last commit: version, folders by bucket, schema, last batch by stream."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "folders": {}, "schema": None, "batches": {}}
        return json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.path}/_commits/{versions[-1]:020d}.json").first()[1])

    def _commit(self, state: dict) -> bool:
        """Whether the number was free."""
        jvm, fs, context, folder = self._hadoop()
        hidden = jvm.Path(folder, f".{uuid.uuid4().hex}")
        out = fs.create(hidden)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        try:
            context.rename(hidden, jvm.Path(folder, f"{state['version']:020d}.json"), gateway.new_array(jvm.Options.Rename, 0))
        except Exception as e:  # noqa: BLE001  only a taken number is expected
            fs.delete(hidden, False)
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        for old in self._versions()[:-KEPT]:
            fs.delete(jvm.Path(folder, f"{old:020d}.json"), False)
        return True

    # --- reading ---

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        return self._rows(self.state(), None)

    def _rows(self, state: dict, buckets: set[str] | None) -> DataFrame:
        folders = [f"{self.path}/{f}" for b, fs in state["folders"].items() if buckets is None or b in buckets for f in fs]
        schema = T.StructType.fromJson(state["schema"]) if state["schema"] else None
        if schema is None:
            raise ValueError(f"nothing is stored in {self.path}")
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # --- writing ---

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """The folder of each bucket that has rows."""
        token = f"data/{uuid.uuid4().hex}"
        # a bucket beyond the advised size goes to several tasks, so that none grows with the table
        rows.withColumn("_bucket", self.bucket()).hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.path}/{token}")
        jvm, fs, _, _ = self._hadoop()
        names = [s.getPath().getName() for s in fs.listStatus(jvm.Path(f"{self.path}/{token}")) if s.isDirectory()]
        return {n.partition("=")[2]: f"{token}/{n}" for n in names if n.startswith("_bucket=")}

    def _touched(self, changes: DataFrame) -> set[str]:
        """Buckets of the changed keys: as many numbers as there are buckets, at most."""
        return {str(r[0]) for r in changes.select(self.bucket()).distinct().collect()}

    def _apply(self, changes: DataFrame, work: Callable[[dict, set[str]], tuple[dict[str, list[str]], T.StructType]], batch: tuple[str, int] | None = None) -> bool:
        """Runs ``work`` on the buckets of ``changes`` and commits what it gives for them; False if the batch was committed before."""
        state = self.state()
        if batch and state["batches"].get(batch[0], -1) >= batch[1]:
            return False
        touched = self._touched(changes)
        new, schema = work(state, touched)
        for _ in range(ATTEMPTS):
            folders = {b: f for b, f in state["folders"].items() if b not in touched} | {b: f for b, f in new.items() if f}
            batches = state["batches"] | ({batch[0]: batch[1]} if batch else {})
            if self._commit({"version": state["version"] + 1, "folders": folders, "schema": schema.jsonValue(), "batches": batches}):
                return True
            now = self.state()
            if batch and now["batches"].get(batch[0], -1) >= batch[1]:
                return False
            moved = any(now["folders"].get(b) != state["folders"].get(b) for b in touched) or (now["schema"] != state["schema"] and state["schema"] is not None)
            state = now
            if moved:
                new, schema = work(state, touched)
        raise RuntimeError(f"{ATTEMPTS} other writers came first")

    def create(self, rows: DataFrame) -> bool:
        """The first rows; False if something is stored already."""
        if self.state()["version"]:
            return False
        return self._commit({"version": 1, "folders": {b: [f] for b, f in self._write(rows).items()}, "schema": rows.schema.jsonValue(), "batches": {}})

    def merge(self, changes: DataFrame, how: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> bool:
        """Replaces the buckets that hold keys of ``changes`` by ``how(their rows)``; files of other buckets stay as they are.

        ``how`` is one of the merges of ``sinks``, for example ``lambda old: sinks.update(old, changes, "id")``, and must only
        add, change or drop rows of keys in ``changes``."""

        def work(state: dict, touched: set[str]) -> tuple[dict[str, list[str]], T.StructType]:
            old = self._rows(state, touched)
            new = how(old).select(*old.columns)
            return {b: [f] for b, f in self._write(new).items()}, old.schema

        return self._apply(changes, work, batch)

    def insert_new(self, rows: DataFrame, order: list[str], batch: tuple[str, int] | None = None) -> bool:
        """STR-2: rows whose keys are not stored yet, of each key the first by ``order`` (then by the other columns). Rows without a key are
        left out: nothing could tell whether they are stored."""
        for k in self.keys:
            rows = rows.where(F.col(k).isNotNull())
        rest = [c for c, kind in rows.dtypes if c not in (*self.keys, *order) and not kind.startswith("map")]
        first = W.partitionBy(*self.keys).orderBy(*order, *rest)
        fresh = rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")

        def work(state: dict, touched: set[str]) -> tuple[dict[str, list[str]], T.StructType]:
            full = {b for b in touched if len(state["folders"].get(b, ())) >= FOLDERS}
            if state["schema"] is None:
                return {b: [f] for b, f in self._write(fresh).items()}, rows.schema
            old = self._rows(state, touched)
            unseen = fresh.select(*old.columns).join(old.select(*self.keys), self.keys, "left_anti").select(*old.columns)
            if full:  # many small folders become one
                unseen = unseen.unionByName(self._rows(state, full))
            added = self._write(unseen)
            return {b: ([] if b in full else state["folders"].get(b, [])) + ([added[b]] if b in added else []) for b in touched}, old.schema

        return self._apply(rows, work, batch)

    def sink(self, query: str, order: list[str]) -> Callable[[DataFrame, int], None]:
        """STR-2: a ``foreachBatch`` function. ``query`` names the stream together with its checkpoint: a stream that starts
        anew, with batch 0 again, takes another name."""

        def store(batch: DataFrame, batch_id: int) -> None:
            rows = batch.persist()
            try:
                self.insert_new(rows, order, (query, batch_id))
            finally:
                rows.unpersist()

        return store

    def merge_sink(self, query: str, how: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function that merges each batch once: ``how(old rows, batch)``."""

        def store(batch: DataFrame, batch_id: int) -> None:
            rows = batch.persist()
            try:
                self.merge(rows, lambda old: how(old, rows), (query, batch_id))
            finally:
                rows.unpersist()

        return store

    def vacuum(self) -> int:
        """Deletes data folders that no kept commit names; to be run when no writer is at work. The number deleted."""
        jvm, fs, _, folder = self._hadoop()
        used = set()
        for v in self._versions():
            state = json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.path}/_commits/{v:020d}.json").first()[1])
            used |= {f.split("/")[1] for fs_ in state["folders"].values() for f in fs_}
        data = jvm.Path(f"{self.path}/data")
        stale = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in used] if fs.exists(data) else []
        return sum(bool(fs.delete(p, True)) for p in stale)
