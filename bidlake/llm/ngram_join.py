"""Operator 2: n-gram Jaccard join as a blocked sparse matrix product.

Documents are rows and word n-grams columns of a 0/1 matrix; the product of the matrix
with its transpose holds the overlaps. Rows meet in blocks, of which there are two kinds.

Short n-grams (under ``LONG``), which unrelated texts share by chance: rows that link differ in
``k`` columns at most, which their sizes bound. The columns are cut by hash into more than ``k``
ranges, so linked rows agree in all columns of at least one range, and a block is what a
row has in a range. Sizes fall into classes; a row is cut as its own class asks, and as the
class below asks if it can link with a row there. With ``k + 1 + spare`` ranges each row can
leave out its ``spare`` emptiest ones: what one row of a pair leaves out is no more than
``spare`` of the ``spare + 1`` ranges they agree in. Rows with more than ``spare`` ranges empty
also lead with single columns, as below, in place of empty ranges.

Long n-grams: of each row only its leading columns in one global order can be the first that
two similar rows share: a row of ``a`` entries leads with ``a - ceil(t a) + 1``. Blocks are the
columns; heavy ones, found by a sketch of all rows, come last in the order and so lead
nowhere else than in rows made of them alone.

Rows with equal sets are one row. In each block the others are first paired with the
smallest document (a star, never all pairs); pairs must pass bounds derived from their
sizes: the ratio of sizes, and the least symmetric difference that parity bitmaps of both sets
show. For the pairs left, the product is formed: the entries of a hub's row and of its members' travel as
numbers, cut into blocks of columns; block after block is multiplied, the overlaps are added up,
and a pair goes as soon as the columns still to come cannot lift it over the bound of its sizes. Only rows of a block that these links have not joined yet
are paired further, in tiles of bounded size, so groups of copies stay linear and still no
link between different components is lost. ``all_links`` pairs all rows of a block in such tiles, by
the same bounds, and so returns every link between different sets.

Defined results: null and empty texts, and texts without words, have an empty set and link
with nothing; with fewer than n words the whole sequence is one n-gram; a null id is its own
component (null); rows that repeat an id and a text are one node and get equal results; ids should name one text
each (an id with several texts is one node, compared by one of them in each block); ties do not matter, as components do not depend on order; texts of any
length are read whole; empty input gives no rows. Only the id and text columns are read, so extra
columns never clash.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE, WordHash, batch_of, begin, fresh, give_back, id_and_bytes, map_rows, materialize, mix64, schema_of, slices
from .components import components

#: Words of an n-gram from which on single columns make the blocks.
LONG = 5
#: One range in so many, and one more, may be left out by a row.
SPARE = 8
#: Buckets of the sketch that finds heavy columns, as a power of two.
SKETCH_BITS = 18
#: A set's parity bitmap has at least so many bits, and at least this share of its size, rounded up to a power of two.
PARITY_BITS, PARITY_SHARE = 256, 0.75
#: Rows of a tile when a block's unjoined rows are paired.
TILE = 1024
#: Members of a hub that are handled together, and the blocks of columns of their product.
HUB_SHARE, COLUMN_BLOCKS = 512, 8
#: Pairs that are formed at once.
CHUNK = 200_000
#: Candidates that a row names for itself in the first tiled round, the nearest first. The second takes all.
NEAREST = 8
#: Up to so many rows, a list of ids is broadcast to the scan of texts rather than shuffled with it.
BROADCAST_ROWS = 500_000

ROWS = schema_of(doc_id="long", n_shingles="long", d1="long", d2="long", bucket="int", load="long")
LEADING = schema_of(id="long", size="int", parity="binary", keys="array<long>")
PAIRS = schema_of(x="long", y="long")
LINKS = schema_of(x="long", y="long", overlap="long")
CUT = schema_of(doc_id="long", n_shingles="long", d1="long", d2="long", parity="binary", keys="array<long>")
ENTRIES = schema_of(hub="long", salt="int", block="int", member="long", set="long", size="int", columns="binary")


def shingles(body: bytes | None, n: int, hashes: WordHash) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams of a text, A-Z in lower case."""
    words = body.lower().split() if body else []
    m = min(n, len(words))
    if not m:
        return np.zeros(0, dtype=np.uint64)
    h = hashes.of(words)
    last = len(words) - m + 1
    key = np.full(last, m, dtype=np.uint64)
    for k in range(m):
        key = mix64(key + h[k : k + last])
    return np.unique(key)


def digests(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, whatever the order of its entries."""
    return tuple(int(mix64(s ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64)) for salt in (0x5555, 0xAAAA))


def _measure(n: int, batches):
    """Row sizes and digests of their sets; after the last row, the partition's loaded buckets."""
    begin()
    arrow = to_arrow_schema(ROWS)
    hashes, load, total = WordHash(), np.zeros(1 << SKETCH_BITS, dtype=np.int64), 0

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            part, rows = batch.slice(lo, SLICE), []
            for doc_id, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                s = shingles(body, n, hashes)
                np.add.at(load, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                total += len(s)
                rows.append((doc_id, len(s), *digests(s), None, None))
            if rows:
                yield emit(rows)
    hashes.clear()
    give_back()
    heavy = np.flatnonzero(load > max(32, 8 * total / len(load)))
    if len(heavy):
        yield emit([(None, None, None, None, int(b), int(load[b])) for b in heavy])


class Cut:
    """How many ranges the rows of each size class are cut into."""

    def __init__(self, percent: int):
        self.percent = percent
        #: (largest size, largest size that can link with that, ranges, spare) by class
        self.classes: list[tuple[int, int, int, int]] = []

    def reach(self, size: int) -> int:
        return 100 * size // self.percent

    def of(self, size: int) -> int:
        """The class of a size; classes are made as they are needed."""
        while not self.classes or self.classes[-1][0] < size:
            top = self.reach(self.reach(self.classes[-1][0] + 1 if self.classes else 1))
            differ = (100 - self.percent) * (top + self.reach(top)) // (100 + self.percent)
            spare = 1 + differ // SPARE
            self.classes.append((top, self.reach(top), differ + 1 + spare if differ else 0, spare))
        return bisect_left(self.classes, (size,))

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The blocks of a row: hashes of what it has in the ranges of its class and the class below."""
        size, found, sparse = len(s), [], False
        own = self.of(size)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(s ^ np.uint64(0x3333)), dtype=np.uint64)])
        for c in (own, own - 1):
            if c < 0:
                break
            _, reach, ranges, spare = self.classes[c]
            if not ranges or size > reach:  # only equal sets can link there
                continue
            step = np.uint64((1 << 64) // ranges + 1)
            ends = np.searchsorted(s // step, np.arange(ranges + 1, dtype=np.uint64))
            counts = np.diff(ends)
            least = int(np.partition(counts, spare)[spare])
            sparse |= least == 0
            used = np.flatnonzero(counts >= max(1, least))
            what = sums[ends[used + 1]] - sums[ends[used]]
            found.append(mix64(what ^ mix64(used.astype(np.uint64) + np.uint64((c + 1) << 32))))
        if sparse:
            found.append(s[: size - -(-self.percent * size // 100) + 1])
        return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def _cut(n: int, percent: int):
    """Kernel: the row's size, digests, parity bitmap and blocks by ranges of columns."""
    hashes, cut = WordHash(), Cut(percent)

    def row(doc_id, body):
        s = shingles(body, n, hashes)
        if not len(s) or doc_id is None:
            return doc_id, len(s), *digests(s), b"", []
        return doc_id, len(s), *digests(s), parity(s), np.unique(cut.keys(s)).view(np.int64).tolist()

    return row


def _lead(n: int, percent: int, heavy):
    """Kernel: the row's size, parity bitmap and leading columns."""
    hashes = WordHash()
    level = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for bucket, load in heavy.value:
        level[bucket] = load

    def row(doc_id, body):
        s = shingles(body, n, hashes)
        size = len(s)
        if not size or doc_id is None:
            return doc_id, size, b"", []
        lv = level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
        order = np.argsort(lv, kind="stable") if lv.any() else np.arange(size)
        lead = s[order[: size - -(-percent * size // 100) + 1]]
        return doc_id, size, parity(s), lead.view(np.int64).tolist()

    return row


def parity(s: np.ndarray) -> bytes:
    """Bit k is the parity of the entries whose mixed hash ends in k: every entry that only one of two
    sets has flips one bit, so bitmaps differ in no more bits than the sets do in entries."""
    bits = PARITY_BITS
    while bits < PARITY_SHARE * len(s):
        bits *= 2
    odd = np.bincount((mix64(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _may_link(percent: int, sx, sy, differ) -> np.ndarray:
    """The size-derived bounds: ratio of sizes, and the largest symmetric difference at the threshold."""
    return (100 * np.minimum(sx, sy) >= percent * np.maximum(sx, sy)) & ((100 + percent) * differ <= (100 - percent) * (sx + sy))


def _fold(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (one a row) at a smaller number of words: halves are added until they fit."""
    while bitmaps.shape[1] > words:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] ^ bitmaps[:, half:]
    return bitmaps


class Rows:
    """Rows of blocks in memory: ids, sizes, labels and parity bitmaps by their length."""

    def __init__(self, ids, sizes, labels, bitmaps: list[bytes]):
        self.ids, self.sizes, self.labels = np.asarray(ids), np.asarray(sizes, dtype=np.int64), labels
        self.words = np.array([len(b) // 8 for b in bitmaps], dtype=np.int64)
        self.at = np.zeros(len(bitmaps), dtype=np.int64)  # place in the matrix of its length
        self.matrix: dict[int, np.ndarray] = {}
        for w in np.unique(self.words).tolist():
            those = np.flatnonzero(self.words == w)
            self.at[those] = np.arange(len(those))
            self.matrix[w] = np.frombuffer(b"".join([bitmaps[k] for k in those.tolist()]), dtype=np.uint64).reshape(len(those), w)

    def passing(self, percent: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs of rows (a, b) those within the bounds, with the differing bits of each."""
        sa, sb = self.sizes[a], self.sizes[b]
        ok = _may_link(percent, sa, sb, np.zeros(len(a), dtype=np.int64))
        if self.labels is not None:
            ok &= self.labels[a] != self.labels[b]
        a, b = a[ok], b[ok]
        differ = np.zeros(len(a), dtype=np.int64)
        shape = self.words[a] * (1 << 20) + self.words[b]
        for key in np.unique(shape).tolist():
            those = np.flatnonzero(shape == key)
            wa, wb = key >> 20, key & ((1 << 20) - 1)
            w = min(wa, wb)
            x, y = _fold(self.matrix[wa][self.at[a[those]]], w), _fold(self.matrix[wb][self.at[b[those]]], w)
            differ[those] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        ok = _may_link(percent, self.sizes[a], self.sizes[b], differ)
        return a[ok], b[ok], differ[ok]


def _groups(batches, n_keys: int):
    """Columns of whole groups, several at a time, from batches sorted by their first ``n_keys`` columns."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        keys = [table.column(k).to_numpy() for k in range(n_keys)]
        change = np.zeros(table.num_rows, dtype=bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change)])
        last = int(starts[-1])
        if last:
            yield table.slice(0, last), starts[:-1]
        held = table.slice(last).combine_chunks()
    if held is not None:
        yield held, np.zeros(1, dtype=np.int64)


def _star(percent: int, batches):
    """(key, salt, id or null, size, parity, hub) in blocks with the hub first: members that may link with it."""
    arrow = to_arrow_schema(PAIRS)
    for table, starts in _groups(batches, 2):
        ends = np.concatenate([starts[1:], [table.num_rows]])
        rows = Rows(table.column(2).to_numpy(), table.column(3).to_numpy(), None, table.column(4).to_pylist())
        counts = ends - starts - 1
        hub = np.repeat(starts, counts)
        member = np.concatenate([np.arange(a + 1, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] or [np.zeros(0, dtype=np.int64)])
        x, y, _ = rows.passing(percent, member, hub)
        if len(x):
            pairs = np.unique(np.stack([rows.ids[x], rows.ids[y]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=arrow)


def _tiles(percent: int, nearest: int | None, batches):
    """(key, i, j, id, size, parity, comp, side) in tiles: pairs of rows that are not joined yet and pass the bounds."""
    arrow = to_arrow_schema(PAIRS)

    def emit(rows, found):
        x, y, differ = (np.concatenate(c) for c in zip(*found, strict=True))
        if nearest is not None and len(x):
            order = np.lexsort((differ, x))
            x, y = x[order], y[order]
            first = np.concatenate([[True], x[1:] != x[:-1]])
            since = np.arange(len(x)) - np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))
            x, y = x[since < nearest], y[since < nearest]
        a, b = rows.ids[x], rows.ids[y]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=arrow)

    for table, starts in _groups(batches, 3):
        rows = Rows(table.column(3).to_numpy(), table.column(4).to_numpy(), table.column(6).to_numpy(), table.column(5).to_pylist())
        mixed = table.column(1).to_numpy() != table.column(2).to_numpy()
        side = table.column(7).to_numpy()
        ends = np.concatenate([starts[1:], [table.num_rows]])
        # each row meets the rows after it in its tile
        until = np.repeat(ends, ends - starts)
        ahead = until - np.arange(len(until)) - 1
        cut = np.cumsum(ahead)
        lo, found = 0, []
        while lo < len(ahead):
            done = cut[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(cut, done + CHUNK, side="right")))
            n = ahead[lo:hi]
            a = np.repeat(np.arange(lo, hi), n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            ok = ~mixed[a] | (side[a] != side[b])
            kept = rows.passing(percent, a[ok], b[ok])
            if len(kept[0]):
                found.append(kept)
            lo = hi
            if nearest is None and found:
                yield emit(rows, found)
                found = []
        if found:
            yield emit(rows, found)


def _entries(n: int, batches):
    """Rows (hub, salt, member or null, set, body): the entries of the text's row, in blocks of columns."""
    begin()
    arrow = to_arrow_schema(ENTRIES)
    hashes = WordHash()
    edges = np.arange(1, COLUMN_BLOCKS, dtype=np.uint64) * np.uint64((1 << 64) // COLUMN_BLOCKS)
    last, cells = None, []
    for rows in slices(batches):
        out = []
        for hub, salt, member, name, body in rows:
            if last != body:  # the roles of a text come one after another
                s = shingles(body, n, hashes)
                last, cells = body, [(k, len(s), c.tobytes()) for k, c in enumerate(np.split(s, np.searchsorted(s, edges)))]
            out += [(hub, salt, k, member, name, size, c) for k, size, c in cells]
        if out:
            yield batch_of(out, arrow)
    del last, cells
    give_back()


class Product:
    """A hub's row times the rows of its members, added up block by block of columns."""

    def __init__(self, percent: int, size: int):
        self.percent, self.size, self.left = percent, size, size
        #: by (member, its set): overlap so far, entries still to come, size; None if discarded
        self.rows: dict[tuple, list[int] | None] = {}

    def least(self, a: int, b: int) -> int:
        """The smallest overlap at which sets of these sizes link."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def add(self, own: np.ndarray, members: dict[tuple, tuple[int, np.ndarray]]) -> None:
        """One block: the hub's entries, and size and entries of each (member, set)."""
        self.left -= len(own)
        kept = [(m, c) for m, (size, c) in members.items() if self.rows.setdefault(m, [0, size, size]) is not None]
        if not kept:
            return
        lengths = np.array([len(c) for _, c in kept])
        columns = np.concatenate([c for _, c in kept])
        at = np.searchsorted(own, columns)
        hit = np.zeros(len(columns), dtype=bool)
        inside = at < len(own)
        hit[inside] = own[at[inside]] == columns[inside]
        overlaps = np.bincount(np.repeat(np.arange(len(kept)), lengths), weights=hit, minlength=len(kept)).astype(np.int64)
        for (m, _), more, gone in zip(kept, overlaps.tolist(), lengths.tolist(), strict=True):
            row = self.rows[m]
            row[0] += more
            row[1] -= gone
            if row[0] + min(row[1], self.left) < self.least(self.size, row[2]):
                self.rows[m] = None


def _product(percent: int, batches):
    """ENTRIES in the order of (hub, salt, block), the hub's own first: its links, with overlaps. An id with
    several texts has a row for each, and links if one of them does."""
    begin()
    arrow = to_arrow_schema(LINKS)
    key = block = None
    products: dict[int, Product] = {}
    own: dict[int, np.ndarray] = {}
    members: dict[tuple, tuple[int, np.ndarray]] = {}

    def step():
        for name, entries in own.items():
            products[name].add(entries, members)

    def emit():
        best: dict[int, int] = {}
        for product in products.values():
            for (member, _), row in product.rows.items():
                if row is not None:
                    best[member] = max(row[0], best.get(member, 0))
        return [batch_of([(m, key[0], overlap) for m, overlap in best.items()], arrow)] if best else []

    for rows in slices(batches):
        for hub, salt, k, member, name, size, columns in rows:
            if (hub, salt) != key:
                step()
                yield from emit()
                key, block, products, own, members = (hub, salt), k, {}, {}, {}
            elif k != block:
                step()
                block, own, members = k, {}, {}
            entries = np.frombuffer(columns, dtype=np.uint64)
            if member is None:
                own[name] = entries
                products.setdefault(name, Product(percent, size))
            else:
                members[member, name] = (size, entries)
    step()
    yield from emit()
    give_back()


class NgramJoin:
    """One join over a table of documents. ``percent`` is the Jaccard threshold in hundredths."""

    def __init__(self, docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"):
        self.n, self.percent = n, percent
        self.texts = id_and_bytes(docs, id_col, text_col)
        self.spark = docs.sparkSession
        #: one row per row of the documents: doc_id, n_shingles, digests of the set
        if n < LONG:
            self.cut = materialize(map_rows(self.texts, partial(_cut, n, percent), CUT))
            self.rows = self.cut.drop("parity", "keys")
        else:
            measured = materialize(self.texts.mapInArrow(partial(_measure, n), ROWS))
            self.rows = measured.where(F.col("bucket").isNull()).drop("bucket", "load")
            self.sketch = measured.where(F.col("bucket").isNotNull())
        same = F.min("doc_id").alias("rep")
        #: digests of each set and the smallest document that has it
        self.sets = self.rows.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(same)

    def _leading(self) -> DataFrame:
        distinct = self.sets.select(F.col("rep").alias("id")).distinct()
        if self.n < LONG:
            return self.cut.select(F.col("doc_id").alias("id"), F.col("n_shingles").cast("int").alias("size"), "parity", "keys").join(distinct, "id", "left_semi")
        loads = self.sketch.groupBy("bucket").agg(F.sum("load").alias("load"))  # no more rows than buckets
        heavy = self.spark.sparkContext.broadcast([(r.bucket, r.load) for r in loads.toLocalIterator()])
        lead = map_rows(self.texts, partial(_lead, self.n, self.percent, heavy), LEADING)
        return materialize(lead.join(distinct, "id", "left_semi"))

    def _star_pairs(self, blocks: DataFrame, lead: DataFrame) -> DataFrame:
        """Distinct (x, y): rows of a block and its smallest document y, within the bounds. Bitmaps
        travel once a pair, after the bound on the ratio of sizes, not once a block."""
        near = 100 * F.least("size", "hub_size") >= self.percent * F.greatest("size", "hub_size")
        sizes = lead.select(F.col("id").alias("hub"), F.col("size").alias("hub_size"))
        pairs = blocks.where("id <> hub").select("id", "size", "hub").distinct()
        pairs = materialize(pairs.join(sizes, "hub").where(near).select("id", "hub"))
        shares = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_SHARE).cast("int").alias("shares"))
        members = pairs.join(shares, "hub").select(
            F.col("hub").alias("key"), F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("salt"), "id", F.lit(1).alias("late")
        )
        hubs = shares.select(F.col("hub").alias("key"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.col("hub").alias("id"), F.lit(0).alias("late"))
        rows = members.unionByName(hubs).join(lead.select("id", "size", "parity"), "id")
        rows = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "late").select("key", "salt", "id", "size", "parity")
        return rows.mapInArrow(partial(_star, self.percent), PAIRS)

    def _checked(self, pairs: DataFrame) -> DataFrame:
        """Exact overlaps of distinct pairs (x, y) that link: each member's entries go to its hub y."""
        share = pairs.groupBy("y").agg(F.ceil(F.count("*") / HUB_SHARE).cast("int").alias("shares"))
        members = pairs.join(share, "y").select(
            F.col("x").alias("id"), F.col("y").alias("hub"), F.pmod(F.xxhash64("x"), F.col("shares")).cast("int").alias("salt"), F.col("x").alias("member")
        )
        hubs = share.select(F.col("y").alias("id"), F.col("y").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.lit(None).cast("long").alias("member"))
        roles = materialize(members.unionByName(hubs))
        texts = self.texts.withColumn("set", F.xxhash64("body"))
        rows = texts.join(F.broadcast(roles) if roles.count() <= BROADCAST_ROWS else roles, "id")
        cells = rows.select("hub", "salt", "member", "set", "body").mapInArrow(partial(_entries, self.n), ENTRIES)
        sorted_cells = cells.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "block", F.col("member").asc_nulls_first(), "set")
        return materialize(sorted_cells.mapInArrow(partial(_product, self.percent), LINKS))

    def _blocks(self) -> tuple[DataFrame, DataFrame]:
        """(key, id, size, hub, n) rows of blocks, and the rows' sizes and bitmaps."""
        lead = self._leading()
        cells = lead.select("id", "size", F.explode("keys").alias("key"))
        blocks = cells.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").cast("int").alias("n")).where("n > 1")
        return materialize(cells.join(blocks, "key")), lead

    def all_links(self) -> DataFrame:
        """(x, y, overlap), x < y: every two different sets that link, each named by its smallest document
        (``membership`` names all of its documents). The result grows with the square of a group of near copies."""
        blocks, lead = self._blocks()
        alone = lead.select(F.col("id").alias("node"), F.col("id").alias("component"))
        pairs = self._star_pairs(blocks, lead).unionByName(self._tiled(blocks, lead, alone, None))
        pairs = materialize(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
        return self._checked(pairs)

    def membership(self) -> DataFrame:
        """(doc_id, rep): the smallest document with the same set, of each that has one."""
        rows = self.rows.where("n_shingles > 0 and doc_id is not null")
        return rows.join(self.sets, ["d1", "d2"]).select("doc_id", "rep").distinct()

    def link_counts(self) -> DataFrame:
        """(doc_id, n_links): how many other documents a document links with, of each that has a set; ids must be unique."""
        member = materialize(self.membership())
        sizes = member.groupBy("rep").agg(F.count("*").alias("n"))
        links = self.all_links()
        both = links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        others = both.join(sizes.select(F.col("rep").alias("y"), "n"), "y").groupBy("x").agg(F.sum("n").alias("others"))
        counts = sizes.join(others.withColumnRenamed("x", "rep"), "rep", "left").select("rep", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        return member.join(counts, "rep").select("doc_id", "n_links")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(x, y, overlap) links between sets that span all components, and (node, component)."""
        blocks, lead = self._blocks()
        star = materialize(self._star_pairs(blocks, lead))
        tested = star.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        links = self._checked(star)
        joined = components(links)
        for nearest in (NEAREST, None):
            more = materialize(self._tiled(blocks, lead, joined, nearest).join(tested, ["x", "y"], "left_anti"))
            if more.isEmpty():  # the nearest may all have been tested; only the uncapped round shows that none is left
                continue
            tested = tested.unionByName(more)
            links = links.unionByName(self._checked(more))
            joined = components(links)
        return links, joined

    def _tiled(self, blocks: DataFrame, lead: DataFrame, joined: DataFrame, nearest: int | None) -> DataFrame:
        """Pairs (x < y) within blocks between rows of different components that pass the bounds."""
        known = joined.select(F.col("node").alias("id"), F.col("component").alias("known"))
        # a block's hub has met every other row already
        rows = blocks.where("id <> hub and n > 2").join(known, "id", "left").select("key", "id", F.coalesce("known", "id").alias("comp"))
        split = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo < hi")
        rows = rows.join(split.select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "key")
        rows = rows.join(lead.select("id", "size", "parity"), "id")
        tile = F.pmod(F.xxhash64("id", F.lit(1)), F.col("tiles")).cast("int")
        rows = rows.withColumn("tile", tile)
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        rows = rows.withColumn("other", other)
        placed = rows.select(
            "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "id", "comp", "size", "parity",
            F.when(F.col("tile") <= F.col("other"), 0).otherwise(1).alias("side"),
        )
        placed = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "id", "size", "parity", "comp", "side")
        return placed.mapInArrow(partial(_tiles, self.percent, nearest), PAIRS).distinct()

    def classes(self) -> DataFrame:
        """Every row's doc_id, n_shingles and component_id: the smallest document linked with it
        directly or over others, itself included."""
        _, joined = self.links()
        known = joined.select(F.col("node").alias("rep"), "component")
        sets = self.sets.join(known, "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("class"))
        rows = self.rows.join(sets, ["d1", "d2"], "left")
        # an empty set links with nothing
        own = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("class"))).otherwise(F.col("doc_id"))
        return rows.select("doc_id", "n_shingles", own.alias("component_id"))


def similar_classes(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return NgramJoin(docs, n, percent, id_col, text_col).classes()


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first document (smallest id) of each class, and all that link with nothing, with all columns."""
    (gone,) = fresh(docs, "gone")
    dropped = similar_classes(docs, n, percent, id_col, text_col).where("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, docs[id_col].cast("long") == dropped[gone], "left_anti")
