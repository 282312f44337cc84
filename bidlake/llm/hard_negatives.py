"""Operator 11: hard negatives by exact search over one-dimensional distance keys.

Vectors get one more component that makes all of them equally long, so that the largest inner
product with an anchor (whose own added component is 0) is the smallest distance. Every vector is keyed by its
nearest pivot and the distance to it, and the table is stored sorted by (pivot, distance) in blocks.
Stretches of a pivot's keys are *cells*: 64 pivots with 64 cells each at most, whatever the table's
size. By the triangle inequality a cell's keys bound the distance from an anchor to its
rows, so a search takes an anchor's cells from the nearest on, in rounds of 8, 64, 512 and all, and ends
for an anchor when what is left cannot reach the last score that it holds. Searches with a highest
score leave out cells that lie wholly nearer than that, so they look through a ring.

The pivots are fitted to a sample of ``SAMPLE`` rows (by the hash of a row's place); every row is indexed, and the
bounds hold for any pivots, so results are exact. Each round sends the anchors that still look, in tiles, to the
cells that they need; a hot cell is cut to shares of 16 blocks. Scores of a tile and a block are one matrix product.

Defined results: rows with a null label or vector, or a null, NaN or infinite component, take no part, nor do rows whose
squared length passes 2^62, as scores are 64-bit numbers; a shorter vector counts as filled up with zeros; rows that repeat an id are
rows of their own, as anchors and as others; rows without an id are no anchors and come after the others of their
score; an empty table gives no rows. Only the three columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import batch_of, begin, give_back, materialize, schema_of, shared_folder, small
from .lexical_search import drop

#: Rows that the pivots are fitted to, pivots, and cells of a pivot, at most.
SAMPLE, PIVOTS, CELLS = 2048, 64, 64
#: Rows of a block, anchors of a tile, blocks of a share; rows that a cell should have at least on average.
BLOCK, TILE, SHARE, CELL_ROWS = 1024, 256, 16, 1024
#: Cells of an anchor looked through after each round; the last round takes all.
GROWTH = (8, 64, 512, PIVOTS * CELLS)
LOWEST, HIGHEST = -(2**63), 2**63 - 1

VECTOR = schema_of(row="long", id="long", label="long", size="long", norm="long", largest="long", vec="binary")
KEYED = schema_of(row="long", id="long", label="long", vec="binary", pivot="int", dist="double")
BLOCKS = schema_of(block="long", pivot="int", low="double", high="double", n="long", rows="binary", ids="binary", unnamed="binary", labels="binary", vecs="binary")
SHARES = schema_of(cell="int", share="int", q="binary", q_row="binary", q_label="binary", q_low="binary", q_high="binary", q_kth="binary", q_vecs="binary")
FOUND = schema_of(q="long", score="long", id="long", row="long")


def _whole_vectors(embeddings: DataFrame, id_col: str, label: F.Column, vec_col: str, scale: int) -> DataFrame:
    """(row, id, label, size, norm, largest, vec): rows that take part, components ``floor(scale * x)`` as doubles."""

    arrow = to_arrow_schema(VECTOR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                part = part.filter(pc.and_(pc.is_valid(part.column(2)), pc.is_valid(part.column(3))))
                vecs = part.column(3)
                sizes = pc.list_value_length(vecs).to_numpy(zero_copy_only=False)
                flat = vecs.flatten()  # null components become NaN
                x = np.floor(scale * (flat.fill_null(np.nan) if flat.null_count else flat).to_numpy(zero_copy_only=False))
                ends = np.cumsum(sizes)
                columns: list[list] = [[], [], [], []]
                for k, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
                    v = x[a:b]
                    norm = float(v @ v)
                    if norm < 2.0**62:  # not NaN, not infinite
                        columns[0].append(k)
                        columns[1].append(int(norm) if norm < 2.0**53 else sum(int(c) * int(c) for c in v))
                        columns[2].append(int(np.abs(v).max(initial=0)))
                        columns[3].append(v.tobytes())
                kept = part.take(pa.array(columns[0], type=pa.int64()))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(2), pa.array(sizes[columns[0]].astype(np.int64)), *[pa.array(c, type=f.type) for c, f in zip(columns[1:], list(arrow)[4:], strict=True)]], schema=arrow)
        give_back()

    rows = embeddings.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, VECTOR)


class Pivots:
    """Pivots in the lengthened space, fitted to a sample."""

    def __init__(self, sample: np.ndarray, most: float, count: int):
        self.most = most  # the common squared length
        points = np.column_stack([sample, np.sqrt(np.maximum(0, most - (sample * sample).sum(1)))])
        centres = points[:1]
        while len(centres) < count:  # the farthest from those there are
            gap = np.min([((points - c) ** 2).sum(1) for c in centres], axis=0)
            if gap.max() <= 0:
                break
            centres = np.vstack([centres, points[gap.argmax()]])
        for _ in range(8):
            near = self._squared(points, centres).argmin(1)
            centres = np.vstack([points[near == k].mean(0) if (near == k).any() else centres[k] for k in range(len(centres))])
        self.centres = centres

    @staticmethod
    def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.maximum(0, (points * points).sum(1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(1))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows, lengthened to the common length, to the pivots."""
        return np.sqrt(self._squared(np.column_stack([x, np.sqrt(np.maximum(0, self.most - (x * x).sum(1)))]), self.centres))

    def of_anchors(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(self._squared(np.column_stack([x, np.zeros(len(x))]), self.centres))


class Index:
    """The stored blocks, and what every task may know of them: pivots and the directory of cells."""

    def __init__(self, vectors: DataFrame, folder: str):
        spark = vectors.sparkSession
        vectors.write.parquet(f"{folder}/vectors")
        self.vectors = spark.read.parquet(f"{folder}/vectors")
        rows, self.size, most, largest = self.vectors.agg(F.count("*"), F.max("size"), F.max("norm"), F.max("largest")).first()
        self.rows = rows
        if not rows:
            return
        self.most, self.exact_floats = most, most < 2**53
        self.kind = np.dtype(np.int16 if largest < 2**15 else np.int32 if largest < 2**31 else np.float64)
        sample = self.vectors.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("vec").toArrow()["vec"].to_pylist()
        self.pivots = Pivots(self.stack(sample), float(most), int(min(PIVOTS, max(1, rows // (4 * CELL_ROWS)))))
        per_pivot = int(min(CELLS, max(1, rows // (CELL_ROWS * len(self.pivots.centres)))))
        keyed = self._keyed().repartitionByRange("pivot", "dist", "row").sortWithinPartitions("pivot", "dist", "row")
        self._packed(keyed).write.parquet(f"{folder}/blocks")
        blocks = spark.read.parquet(f"{folder}/blocks")
        span = blocks.groupBy("pivot").agg(F.min("low").alias("first"), F.max("low").alias("last"))  # a row a pivot
        step = F.when(F.col("last") > F.col("first"), F.floor(per_pivot * (F.col("low") - F.col("first")) / (F.col("last") - F.col("first")))).otherwise(0)
        cell = F.col("pivot") * per_pivot + F.least(F.lit(per_pivot - 1), step)
        placed = blocks.join(F.broadcast(span), "pivot").withColumn("cell", cell.cast("int")).drop("first", "last")
        found = placed.groupBy("cell").agg(F.min("low"), F.max("high"), F.count("*")).orderBy("cell").collect()  # PIVOTS * CELLS rows at most
        self.cell = np.array([r[0] for r in found])
        self.cell_pivot = self.cell // per_pivot
        self.low, self.high = np.array([r[1] for r in found]), np.array([r[2] for r in found])
        self.shares = np.array([-(-r[3] // SHARE) for r in found])
        counts = spark.createDataFrame([(int(c), int(s)) for c, s in zip(self.cell, self.shares, strict=True)], "cell int, shares int")
        self.blocks = placed.join(F.broadcast(counts), "cell").withColumn("share", F.pmod(F.xxhash64("block"), "shares").cast("int"))

    def stack(self, vecs: list[bytes]) -> np.ndarray:
        """Rows of equal length, as doubles."""
        out = np.zeros((len(vecs), self.size or 0))
        for k, v in enumerate(vecs):
            x = np.frombuffer(v, dtype=np.float64)
            out[k, : len(x)] = x
        return out

    def _keyed(self) -> DataFrame:
        pivots, stack, arrow = self.pivots, self.stack_of(), to_arrow_schema(KEYED)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin()
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    dist = pivots.of_rows(stack(part.column(3).to_pylist()))
                    near = dist.argmin(1)
                    columns = [part.column(k) for k in range(4)] + [pa.array(near.astype(np.int32)), pa.array(dist[np.arange(len(near)), near])]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)
            give_back()

        return self.vectors.select("row", "id", "label", "vec").mapInArrow(run, KEYED)

    def stack_of(self):
        """``stack`` without the frames that a task cannot hold."""
        bare = Index.__new__(Index)
        bare.size = self.size
        return bare.stack

    def _packed(self, keyed: DataFrame) -> DataFrame:
        """Neighbours by key in one block; a block's rows in the order of their ids."""
        stack, kind, arrow = self.stack_of(), self.kind, to_arrow_schema(BLOCKS)

        def block(rows: list[tuple]) -> tuple:
            dist = [r[5] for r in rows]
            rows = sorted(rows, key=lambda r: (r[1] is None, r[1], r[0]))
            longs = lambda values: np.array(values, dtype=np.int64).tobytes()
            vecs = stack([r[3] for r in rows]).astype(kind).tobytes()
            return rows[0][0], rows[0][4], min(dist), max(dist), len(rows), longs([r[0] for r in rows]), longs([r[1] or 0 for r in rows]), np.array([r[1] is None for r in rows]).tobytes(), longs([r[2] for r in rows]), vecs

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin()
            held: list[tuple] = []
            for batch in batches:
                for row in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                    if held and (len(held) == BLOCK or held[-1][4] != row[4]):
                        yield batch_of([block(held)], arrow)
                        held = []
                    held.append(row)
            if held:
                yield batch_of([block(held)], arrow)
            give_back()

        return keyed.mapInArrow(run, BLOCKS)

    def _wanted(self, state: DataFrame, first: int, last: int) -> DataFrame:
        """The tiles of searches that still look, for each cell among their ``first`` to ``last`` nearest."""
        pivots, most, kind, stack, arrow = self.pivots, float(self.most), self.kind, self.stack_of(), to_arrow_schema(SHARES)
        cells, owner, low, high, shares = self.cell, self.cell_pivot, self.low, self.high, self.shares

        def tile(rows: list[tuple]) -> Iterator[tuple]:
            ids, own, label, least, top, kth = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(6))
            x = stack([r[6] for r in rows])
            norms = (x * x).sum(1)
            dist = pivots.of_anchors(x)[:, owner]
            slack = 1 + 1e-6 * (most + norms[:, None])
            nearest = np.maximum(0, np.maximum(low - dist, dist - high))
            best = (norms[:, None] + most - nearest**2) / 2 + slack  # no row of the cell scores more
            worst = (norms[:, None] + most - (dist + high) ** 2) / 2 - slack  # nor less
            order = np.argsort(-best, axis=1, kind="stable")[:, first:last]
            picked = np.zeros(best.shape, dtype=bool)
            np.put_along_axis(picked, order, True, axis=1)
            picked &= (best >= np.maximum(least, kth)[:, None]) & (worst <= top[:, None])
            for c in np.flatnonzero(picked.any(0)).tolist():
                k = picked[:, c]
                packed = [v[k].tobytes() for v in (ids, own, label, least, top, kth)] + [x[k].astype(kind).tobytes()]
                for s in range(int(shares[c])):
                    yield int(cells[c]), s, *packed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin()
            for batch in batches:
                for at in range(0, batch.num_rows, TILE):
                    part = batch.slice(at, TILE)
                    for row in tile(list(zip(*(part.column(k).to_pylist() for k in range(7)), strict=True))):
                        yield batch_of([row], arrow)
            give_back()

        return state.select("q", "q_row", "q_label", "q_low", "q_high", "kth", "vec").mapInArrow(run, SHARES)

    def _looked_through(self, wanted: DataFrame, same: bool, k: int) -> DataFrame:
        """The k best fitting rows of each search and block."""
        kind, size, floats, arrow = self.kind, self.size, self.exact_floats, to_arrow_schema(FOUND)

        def scores(q: bytes, x: bytes) -> np.ndarray:
            form = np.float64 if floats else np.int64  # whole numbers under 2^53 are exact in either
            a, b = (np.frombuffer(v, dtype=kind).reshape(-1, size).astype(form) for v in (q, x))
            return (a @ b.T).astype(np.int64)

        def best(row: dict) -> pa.RecordBatch | None:
            longs = {c: np.frombuffer(row[c], dtype=np.int64) for c in ("rows", "ids", "labels", "q", "q_row", "q_label", "q_low", "q_high", "q_kth")}
            s = scores(row["q_vecs"], row["vecs"]) if size else np.zeros((len(longs["q"]), len(longs["rows"])), dtype=np.int64)
            alike = longs["q_label"][:, None] == longs["labels"]
            fits = (alike if same else ~alike) & (longs["q_row"][:, None] != longs["rows"])
            fits &= (s >= np.maximum(longs["q_low"], longs["q_kth"])[:, None]) & (s <= longs["q_high"][:, None])
            at, of = np.nonzero(fits)  # by search, then by place, which is the order of the ids
            value = s[at, of]
            order = np.lexsort((of, -value, at))
            at, of, value = at[order], of[order], value[order]
            starts = np.searchsorted(at, at, side="left")
            keep = np.arange(len(at)) - starts < k
            at, of, value = at[keep], of[keep], value[keep]
            if not len(at):
                return None
            unnamed = np.frombuffer(row["unnamed"], dtype=bool)[of]
            return pa.RecordBatch.from_arrays([pa.array(longs["q"][at]), pa.array(value), pa.array(longs["ids"][of], mask=unnamed), pa.array(longs["rows"][of])], schema=arrow)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin()
            for batch in batches:
                for at in range(batch.num_rows):
                    one = batch.slice(at, 1)
                    found = best({name: one.column(j)[0].as_py() for j, name in enumerate(one.schema.names)})
                    if found is not None:
                        yield found
            give_back()

        columns = ("rows", "ids", "unnamed", "labels", "vecs")
        pairs = wanted.join(self.blocks.select("cell", "share", *columns), ["cell", "share"]).drop("cell", "share")
        return pairs.mapInArrow(run, FOUND)

    def search(self, searches: DataFrame, same: bool, k: int) -> DataFrame:
        """(q, score, id, row, rank): for each search (q, q_row, q_label, q_low, q_high, vec), a checkpointed table, the k best rows of the
        same or of other labels with q_low <= score <= q_high, without q_row itself; ties by id."""
        top, state = None, searches.withColumn("kth", F.lit(LOWEST))
        first, cells = 0, len(self.cell)
        for last in GROWTH:
            wanted = self._wanted(state, first, last)
            if first and wanted.isEmpty():  # what is left is out of reach for every search
                break
            found = self._looked_through(wanted, same, k)
            both = found if top is None else top.drop("rank").unionByName(found)
            order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
            top = materialize(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
            first = last
            if first >= cells:
                break
            kth = top.where(F.col("rank") == k).select("q", F.col("score").alias("kth"))
            state = materialize(searches.join(small(kth), "q", "left").withColumn("kth", F.coalesce("kth", F.lit(LOWEST))))
        return top


def hard_negatives(embeddings: DataFrame, label: F.Column, anchor: F.Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each row where ``anchor`` holds and each of its first ``positives`` rows of the same ``label``, the first ``negatives`` rows of
    other labels whose score is ``low`` to ``high`` per cent of the positive's. Both columns are expressions on ``embeddings``. Stored
    blocks live in the shared folder while the job runs."""
    spark = embeddings.sparkSession
    folder = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    marked = embeddings.select(F.col(id_col), F.col(vec_col), label.cast("long").alias("_label"))
    index = Index(_whole_vectors(marked, id_col, F.col("_label"), vec_col, scale), folder)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not index.rows:
        drop(spark, folder)
        return spark.createDataFrame([], empty)
    anchors = index.vectors.withColumnRenamed("id", id_col).where(anchor).withColumnRenamed(id_col, "id")
    anchors = materialize(anchors.select(F.col("row").alias("q"), F.col("row").alias("q_row"), F.col("label").alias("q_label"), F.lit(LOWEST).alias("q_low"), F.lit(HIGHEST).alias("q_high"), "vec", F.col("id").alias("anchor_id")))
    near = index.search(anchors.drop("anchor_id"), True, positives)
    # bounds in whole numbers: low * p <= 100 * n <= high * p
    floor_div = lambda a: F.floor(a.cast("decimal(38,0)") / 100).cast("long")
    pairs = near.select(F.col("q").alias("q_row"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place"))
    pairs = pairs.withColumn("q_low", -floor_div(-low * F.col("positive_score").cast("decimal(30,0)"))).withColumn("q_high", floor_div(high * F.col("positive_score").cast("decimal(30,0)")))
    pairs = pairs.where("q_low <= q_high").join(anchors.select("q_row", "q_label", "vec", "anchor_id"), "q_row").withColumn("q", F.monotonically_increasing_id())
    pairs = materialize(pairs)
    hard = index.search(pairs.select("q", "q_row", "q_label", "q_low", "q_high", "vec"), False, negatives)
    out = hard.select("q", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(pairs.select("q", "anchor_id", "positive_id", "positive_score"), "q")
    out = materialize(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    drop(spark, folder)
    return out
