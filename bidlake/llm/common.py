"""Shared plumbing of the training-data operators.

Row kernels run through ``mapInArrow`` in small slices, so a Python worker
holds at most ``SLICE`` rows beside the Arrow batch that it was handed.
Texts travel as UTF-8 bytes: byte-wise ``translate``/``split`` is much faster
than ``str`` work, and kernels decode only where code points matter.

Workers live on between tasks and stages, so what one keeps is bounded: at most one
large object (``resident``), which goes when a task asks for another or for none, and at the end
of each partition unused memory goes back to the system.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a kernel turns into Python objects at a time.
SLICE = 256


def schema_of(**columns: str) -> T.StructType:
    """A StructType from ``name="ddl type"`` pairs, without a running session."""
    simple = {
        "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
        "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType(),
    }

    def kind(name: str) -> T.DataType:
        return T.ArrayType(kind(name[6:-1])) if name.startswith("array<") else simple[name]

    return T.StructType([T.StructField(k, kind(v)) for k, v in columns.items()])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows in the order of ``schema`` as one batch; there must be one at least."""
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of the batches as tuples, at most ``SLICE`` at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            part = batch.slice(lo, SLICE)
            yield list(zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True))


def map_rows(df: DataFrame, kernel: Callable[[], Callable], schema: T.StructType, many: bool = False) -> DataFrame:
    """Apply ``kernel()(*row)`` to every row of ``df``.

    ``kernel`` builds its state once for each partition. Its function returns a
    tuple in the order of ``schema``, or with ``many`` an iterable of tuples.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        fn = kernel()
        for rows in slices(batches):
            out = [x for r in rows for x in fn(*r)] if many else [fn(*r) for r in rows]
            if out:
                yield batch_of(out, arrow)
        del fn
        give_back()

    return df.mapInArrow(run, schema)


#: The one large object that a Python worker keeps between tasks, by its key, and whether this task asked for it.
_RESIDENT: dict = {}
_ASKED = [False]


def begin() -> None:
    """The start of a partition's work."""
    _ASKED[0] = False


def resident(key, build: Callable):
    """``build()``, kept in this worker until a task ends that asked for another key or none."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = build()
    _ASKED[0] = True
    return _RESIDENT[key]


def give_back() -> None:
    """The end of a partition's work: what this worker no longer uses goes back to the system."""
    import ctypes
    import gc

    if not _ASKED[0]:
        _RESIDENT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that text kernels read, so the scan is pruned and
    other columns, whatever their names, cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))


def keyed_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, body): a row is known by its id and the hash of its text. Rows that repeat both
    are one document; rows that repeat an id with another text are documents of their own."""
    body = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(body).alias("key"), body.alias("body"))


def join_back(rows: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """``rows`` inner joined with ``groups`` (one row per key; ``n``, how many rows it has, is dropped), safe
    against hot keys: those of over a ten-thousandth of all rows, 10,000 at most, are broadcast, and their
    rows are dealt over all partitions instead of meeting in one. Both must be cheap to read again."""
    values = [c for c in groups.columns if c not in (*keys, "n")]
    is_hot = F.col("n") > max(1000, rows.count() // 10_000)
    packed = groups.select(*keys, F.struct(*values, F.lit(1).alias("_there")).alias("_found"), is_hot.alias("_hot"), F.col("n").alias("_weight"))
    hot = packed.where("_hot").select(*keys, F.col("_found").alias("_hot_found"))
    # a zero that the optimizer does not fold, or hot rows would meet by their key again
    packed = packed.withColumn("_deal", F.when(F.col("_weight") < 0, 1).otherwise(0))
    cold = packed.where("not _hot").select("_deal", *[F.col(k).alias(f"_{k}") for k in keys], "_found")
    marked = rows.join(F.broadcast(hot), list(keys), "left")
    marked = marked.withColumn("_to", F.when(F.col("_hot_found").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1_000_000))).cast("int"))
    on = F.col("_to") == F.col("_deal")
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    out = marked.join(cold, on, "left")
    found = F.coalesce("_hot_found", "_found")
    return out.where(found.isNotNull()).select(*rows.columns, *[found[v].alias(v) for v in values])


#: Rows of ids and hashes up to which a checkpointed table is broadcast rather than shuffled (some 24 MB).
SMALL_ROWS = 1_000_000


def small(table: DataFrame) -> DataFrame:
    """A checkpointed table of a few numbers a row, marked for broadcast if it is within ``SMALL_ROWS``."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the session
    names in ``spark.checkpoint.dir``; where unset (tests), a folder of its own."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def use_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Where that is unset,
    one below the system's temporary folder, which only a session on one machine can share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/bidlake-checkpoints"
    return folder


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(body: bytes) -> str:
    """The text of its bytes; bytes that are no UTF-8 become the replacement character."""
    return body.decode("utf-8", "replace")


#: Odd multipliers of the 64-bit mixer; fixed values of the splitmix64 finaliser.
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of all windows of words, by prefix sums of a polynomial modulo 2^64: the
    cost of a window does not grow with its length."""

    def __init__(self, base: int):
        self.base = base | 1  # odd, so it has an inverse
        self.powers = np.ones(1, dtype=np.uint64)
        self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = 1 << n.bit_length()
            back = pow(self.base, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, self.base, dtype=np.uint64)]), dtype=np.uint64)
                self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, back, dtype=np.uint64)]), dtype=np.uint64)

    def windows(self, h: np.ndarray, width: int) -> np.ndarray:
        """One hash for each start of a window of ``width`` words; none if there are fewer words."""
        n = len(h)
        if n < width:
            return np.zeros(0, dtype=np.uint64)
        self._grow(n)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(h * self.powers[:n], dtype=np.uint64, out=sums[1:])
            return mix64((sums[width:] - sums[: n - width + 1]) * self.inverses[: n - width + 1])


class WordHash(dict):
    """word bytes -> 64-bit hash, remembered; emptied when the words held pass a number of bytes."""

    BYTES = 24_000_000
    #: What an entry takes beside the word's own bytes: its object, the hash, the place in the table.
    EACH = 160

    def __init__(self):
        super().__init__()
        self.held = 0

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        size = len(word) + self.EACH
        if size > self.BYTES // 8:  # a very long word is not kept
            return h
        self.held += size
        if self.held > self.BYTES:
            self.clear()
            self.held = size
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


#: A-Z to a-z; what is neither an ASCII letter or digit nor above 0x7F to a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def alnum_words(body: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. ``bytes.split``
    knows ASCII white space only, so every byte above 0x7F stays in its word."""
    return body.translate(ALNUM).split() if body else []
