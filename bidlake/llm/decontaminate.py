"""Operator 8: benchmark decontamination with an FM-index per training shard.

A shard is a slice of documents. Words that no test phrase holds cannot be part of an
occurrence, so a shard's index covers the stretches of phrase words, each at least as
long as the shortest phrase, with one separator between stretches. Over these
word ids the shard gets a suffix array, its Burrows-Wheeler transform and a wavelet
tree for rank; all phrases search backwards together, one word a step, and their
occurrences are located by stepping back to the next sampled suffix position. Spans
that meet are merged.

A phrase (window) is 13 consecutive words of a benchmark item; an item of fewer words,
but not none, is one window. A document is contaminated if at least one word in twenty is
inside an occurrence.

Defined results: null and empty texts have no words and no hits; null or empty items have
no windows; equal items are both counted; every row of the documents gives one row, so equal rows
and rows without an id get results of their own; texts are read whole; an empty table gives no rows,
and an empty benchmark no hits. Only id and text columns are read, so extra columns never clash. The
benchmark is read on the driver and broadcast if it is within ``MAX_BENCHMARK_BYTES``. A larger one is cut to
chunks of words that overlap by a window less one word, so that an item of any size is dealt out too, and
these over several passes of the documents, none of which broadcasts more than that.
"""

from __future__ import annotations

import hashlib
import re
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, batch_of, begin, give_back, keyed_bytes, map_rows, materialize, schema_of, slices
from .stages import edit_texts

WINDOW = 13
#: Words of a shard at most; a shard never splits a document.
SHARD_WORDS = 200_000
SAMPLE = 8  # every so many text positions, a suffix position is stored
MAX_BENCHMARK_BYTES = 16_000_000
CHUNK_WORDS = 20_000  # of an item that is dealt over passes
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

HITS = schema_of(row="long", doc_id="long", key="long", n_words="long", spans="array<long>", items="array<long>")
CHUNKS = schema_of(item="long", part="int", body="binary")


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; a suffix that ends is smaller than one that goes on."""
    n = len(codes)
    rank = codes.astype(np.int64)
    width = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (np.int64(n) + np.int64(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        changed = np.empty(n, dtype=np.int64)
        changed[0] = 0
        changed[1:] = key[order[1:]] != key[order[:-1]]
        new = np.cumsum(changed)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


class WaveletTree:
    """Rank over a sequence of small integers: one bit vector with running counts a level."""

    def __init__(self, codes: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[np.ndarray, int]] = []
        current = codes
        for shift in range(self.bits - 1, -1, -1):
            bit = (current >> shift) & 1
            ones = np.zeros(len(current) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((ones, len(current) - int(ones[-1])))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo = np.zeros(len(at), dtype=np.int64)
        hi = at.astype(np.int64)
        for level, (ones, zeros) in enumerate(self.levels):
            bit = (symbols >> (self.bits - 1 - level)) & 1
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            lo = np.where(bit == 1, zeros + a, lo - a)
            hi = np.where(bit == 1, zeros + b, hi - b)
        return hi - lo


class FMIndex:
    """Counts and locates integer patterns in an integer sequence, which must end with a 0
    and hold no other (else the order of suffixes and that of rotations would differ)."""

    def __init__(self, codes: np.ndarray, sigma: int):
        order = suffix_array(codes)
        self.bwt = codes[order - 1]
        self.tree = WaveletTree(self.bwt, sigma)
        self.first = np.zeros(sigma + 1, dtype=np.int64)
        np.cumsum(np.bincount(codes, minlength=sigma), out=self.first[1:])
        kept = order % SAMPLE == 0
        self.marked = np.zeros(len(order) + 1, dtype=np.int64)
        np.cumsum(kept, out=self.marked[1:])
        self.sampled = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of equally long patterns, one a row, from their last word back."""
        lo = np.zeros(len(patterns), dtype=np.int64)
        hi = np.full(len(patterns), len(self.bwt), dtype=np.int64)
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            s = patterns[alive, k]
            lo[alive] = self.first[s] + self.tree.rank(s, lo[alive])
            hi[alive] = self.first[s] + self.tree.rank(s, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
            if not len(alive):
                break
        hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by steps back to sampled ones."""
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            todo = todo[self.marked[at[todo] + 1] == self.marked[at[todo]]]
            if len(todo):
                s = self.bwt[at[todo]]
                at[todo] = self.first[s] + self.tree.rank(s, at[todo])
                steps[todo] += 1
        return self.sampled[self.marked[at]] + steps


class Phrases:
    """The benchmark's windows as word codes (from 1), grouped by length, with their items."""

    def __init__(self, items: list[tuple[int, bytes | None]]):
        self.code: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[int]] = {}
        for item, body in items:
            codes = tuple(self.code.setdefault(w, len(self.code) + 1) for w in alnum_words(body))
            for k in range(max(1, len(codes) - WINDOW + 1) if codes else 0):
                windows.setdefault(codes[k : k + WINDOW], set()).add(item)
        self.by_length: list[tuple[int, np.ndarray, list[set[int]]]] = []
        for length in sorted({len(w) for w in windows}):
            same = [w for w in windows if len(w) == length]
            self.by_length.append((length, np.array(same, dtype=np.int64), [windows[w] for w in same]))
        self.shortest = min((x[0] for x in self.by_length), default=0)


def _stretches(known: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of known words that are long enough."""
    edge = np.diff(np.concatenate([[0], known.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= least
    return starts[long], ends[long]


def search_shard(phrases: Phrases, ids: list[tuple], texts: list[list[bytes]]) -> list[tuple]:
    """What a document is known by, its number of words, merged word spans flattened and items, for each."""
    lengths = [len(t) for t in texts]
    out = [[*i, n, [], []] for i, n in zip(ids, lengths, strict=True)]
    total = sum(lengths)
    if not total or not phrases.shortest:
        return [tuple(x) for x in out]
    get = phrases.code.get
    codes = np.zeros(total + len(texts), dtype=np.int64)  # one separator after each document
    starts_at = np.cumsum([0, *[n + 1 for n in lengths]])
    for at, words in zip(starts_at, texts, strict=False):
        if words:
            codes[at : at + len(words)] = [get(w, 0) for w in words]
    starts, ends = _stretches(codes > 0, phrases.shortest)
    if not len(starts):
        return [tuple(x) for x in out]
    sizes = ends - starts + 1
    begin = np.cumsum(sizes) - sizes
    places = np.repeat(starts - begin, sizes) + np.arange(sizes.sum())  # of each indexed word in the shard
    indexed = np.zeros(len(places) + 1, dtype=np.int64)  # 0 ends it, 1 separates, words follow from 2
    indexed[:-1] = codes[places] + 1
    indexed[begin + sizes - 1] = 1
    index = FMIndex(indexed, len(phrases.code) + 2)
    found: dict[int, tuple[list, set]] = {}
    for length, patterns, owners in phrases.by_length:
        lo, hi = index.search(patterns + 1)
        hits = np.flatnonzero(hi > lo)
        if not len(hits):
            continue
        counts = (hi - lo)[hits]
        rows = np.repeat(lo[hits] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        positions = places[index.locate(rows)]
        docs = np.searchsorted(starts_at, positions, side="right") - 1
        for window, doc, at in zip(np.repeat(hits, counts).tolist(), docs.tolist(), (positions - starts_at[docs]).tolist(), strict=True):
            spans, items = found.setdefault(doc, ([], set()))
            spans.append((at, at + length))
            items |= owners[window]
    for doc, (spans, items) in found.items():
        out[doc][-2] = merge(spans)
        out[doc][-1] = sorted(items)
    return [tuple(x) for x in out]


def merge(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted disjoint spans, flattened to start, end, start, end, ..."""
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def _shards(phrases_of, hits_only: bool, batches):
    """Kernel: rows (row, id, key, body) shard by shard; with ``hits_only``, only documents with hits."""
    from pyspark.sql.pandas.types import to_arrow_schema

    begin()
    phrases = Phrases(phrases_of.value)
    arrow = to_arrow_schema(HITS)
    ids, texts, size = [], [], 0

    def emit():
        rows = [r for r in search_shard(phrases, ids, texts) if r[-1] or not hits_only]
        return [batch_of(rows, arrow)] if rows else []

    for rows in slices(batches):
        for *known, body in rows:
            words = alnum_words(body)
            if ids and size + len(words) > SHARD_WORDS:
                yield from emit()
                ids, texts, size = [], [], 0
            ids.append(tuple(known))
            texts.append(words)
            size += len(words)
    if ids:
        yield from emit()
    del phrases, texts
    give_back()


def _chunks():
    def rows(item, body):
        words = alnum_words(body)
        for part, at in enumerate(range(0, max(1, len(words) - WINDOW + 1) if words else 0, CHUNK_WORDS)):
            yield item, part, b" ".join(words[at : at + CHUNK_WORDS + WINDOW - 1])

    return rows


def _dealt(items: DataFrame, size: int) -> list[DataFrame]:
    """The items' chunks in parts of at most ``MAX_BENCHMARK_BYTES``, or of one chunk."""
    chunks = materialize(map_rows(items, _chunks, CHUNKS, many=True))
    largest = chunks.agg(F.coalesce(F.max(F.length("body")), F.lit(0))).first()[0]
    passes = 2 * size // MAX_BENCHMARK_BYTES + 1
    while True:
        number = F.pmod(F.xxhash64("item", "part"), F.lit(passes))
        worst = chunks.groupBy(number).agg(F.sum(F.length("body")).alias("size")).agg(F.max("size")).first()[0] or 0
        if worst <= max(MAX_BENCHMARK_BYTES, largest):
            return [chunks.where(number == k) for k in range(passes)]
        passes *= 2


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """doc_id, key, n_words, merged word spans and items of every row of the documents."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("binary").alias("body"))
    items = items.where(F.col("item").isNotNull() & F.col("body").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0]
    rows = keyed_bytes(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "*")
    share = lambda part: spark.sparkContext.broadcast([(r.item, bytes(r.body)) for r in part.select("item", "body").toLocalIterator()])
    if size <= MAX_BENCHMARK_BYTES:
        return rows.mapInArrow(partial(_shards, share(items), False), HITS).drop("row")
    rows = materialize(rows)  # numbers must stay the same in all passes
    every = None
    for k, part in enumerate(_dealt(items, size)):
        hits = rows.mapInArrow(partial(_shards, share(part), k > 0), HITS)
        every = hits if every is None else every.unionByName(hits)
    every = every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("key").alias("key"), F.max("n_words").alias("n_words"),
        _merged(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return every.drop("row")


def _merged(lists):
    """Flat lists of spans to one flat list of disjoint spans, as ``merge`` does."""
    pairs = F.flatten(
        F.transform(
            lists,
            lambda flat: F.transform(
                F.filter(F.transform(flat, lambda x, i: F.struct(x.alias("a"), F.try_element_at(flat, i + 2).alias("b"), (i % 2).alias("odd"))), lambda p: p["odd"] == 0),
                lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")),
            ),
        )
    )

    def add(done, p):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.greatest(last, p["b"])))
        return F.when(F.size(done) == 0, F.array(p["a"], p["b"])).when(p["a"] <= last, joined).otherwise(F.concat(done, F.array(p["a"], p["b"])))

    return F.aggregate(F.array_sort(pairs), F.array().cast("array<bigint>"), add)


def contamination(hits: DataFrame) -> DataFrame:
    """The contract's columns from :func:`find_hits`, with the hash of the text and the merged spans after them."""
    n_hit = F.aggregate(
        F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x
    )
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "key", "spans",
    )


def cut_words(body: bytes, spans: list[int]) -> bytes:
    """The text without the characters of the given word spans."""
    if not spans:
        return body
    low = body.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    edges = [(m.start(), m.end()) for m in WORD.finditer(low)]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(body[at : edges[a][0]])
        at = edges[b - 1][1]
    out.append(body[at:])
    return b"".join(out)


def digest(items: list[int]) -> str:
    """What ``items_sha256`` holds, for tests."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: bool = True) -> DataFrame:
    """Documents that are not contaminated, with all their columns; with ``cut``, their rarer
    occurrences are cut from the text too. Repeated rows stay as many as they are or all go; rows with a
    null id pass as they are."""
    verdict = contamination(find_hits(docs, benchmark, id_col, text_col)).where("n_hit > 0 and doc_id is not null")
    value = F.when(F.col("contaminated"), F.array().cast("array<bigint>")).otherwise(F.col("spans") if cut else F.lit(None))
    found = verdict.select("doc_id", "key", value.alias("spans")).where("spans is not null").distinct()
    return edit_texts(docs, found, id_col, text_col, _drop_or_cut)


def _drop_or_cut(body: bytes, spans: list[int]) -> bytes | None:
    return cut_words(body, spans) if spans else None
