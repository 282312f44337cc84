"""The sums of DOM-20 without a shuffle of terms (JOIN-13).

Terms go by 64-bit hashes. A first pass over the corpus counts the documents of words, of n-grams and of the queries' own
pairs of words. Other pairs, most of all terms and nearly all of them in one document or two, are not counted: their number is
bounded by that of their words, which bounds the length of a document's vector and so its scores. The second pass gives
for each query the documents whose upper bound reaches its k-th best lower bound; the pairs of these few alone are counted in a
third, and then they are scored exactly. Each pass works out terms in slices of documents and adds up before the shuffle. So what
is shuffled are counts of words and n-grams, and some rows a query and task, whatever the number of documents that share a
common term or of pairs in all. Two terms with one hash would count as one: with a million terms the chance is under one in
ten million.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .extraction import once

#: Terms whose document counts tasks hold, queries, and terms of queries with repeats; beyond them terms are joined.
MAX_TERMS, MAX_QUERIES, MAX_ENTRIES = 6_000_000, 20_000, 4_000_000
#: Texts that a task remembers, hashes that it gathers before it adds them up, words and documents of a slice, and cells of scores and candidates that it holds.
REMEMBERED, GATHERED, SLICE_WORDS, SLICE_DOCS, CELLS = 200_000, 2_000_000, 200_000, 1024, 1_000_000
LOW, HIGH = 3, 5
#: Scores closer than this may be ties, as nine places are compared.
NEAR = 2e-9
_WORD = re.compile(r"\w{2,}")

#: Odd multipliers of neighbouring characters.
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * _STEPS[3]
    x = (x ^ (x >> np.uint64(29))) * _STEPS[4]
    return x ^ (x >> np.uint64(32))


class Numbers(dict):
    """word -> number, in the order in which words come."""

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self)
        return n


def _codes(texts: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, number of each occurrence's word, number of its text)."""
    known, sizes = Numbers(), [len(ws) for ws in texts]
    code = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(texts)), dtype=np.int64, count=sum(sizes))
    return list(known), code, np.repeat(np.arange(len(texts)), sizes)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges, one range after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _counted(owner: np.ndarray, code: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, count) of the distinct pairs of owner and code (below ``most``), in order."""
    key = owner * most + code
    key = np.sort(key.astype(np.int32) if len(key) and (int(owner.max()) + 1) * most < 2**31 else key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    owner, code = np.divmod(key[first].astype(np.int64), max(1, most))
    return owner, code, np.diff(np.append(first, len(key)))


@dataclass
class Entries:
    """Distinct terms of a slice: the hashes of its terms, and of each entry the document, the place of the term and the count, in the order of documents."""

    hashes: np.ndarray
    doc: np.ndarray
    term: np.ndarray
    n: np.ndarray


class Slice:
    """Terms of some texts: their words, neighbouring pairs of words (with the places of both words) and, if asked for, n-grams of characters inside padded tokens."""

    def __init__(self, words: list[list[str]], tokens: list[list[str]] | None):
        self.n_docs = len(words)
        known, code, owner = _codes(words)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in known), dtype=np.uint64, count=len(known))
        self.words = Entries(hashes, *_counted(owner, code, len(known)))
        beside = owner[:-1] == owner[1:]
        doc, pair, n = _counted(owner[:-1][beside], (code[:-1] * len(known) + code[1:])[beside], len(known) ** 2)
        pairs, place = np.unique(pair, return_inverse=True)
        self.left, self.right = np.divmod(pairs, max(1, len(known)))
        self.pairs = Entries(_mix(hashes[self.left] * _STEPS[0] + _mix(hashes[self.right])), doc, place, n)
        self.grams = self._grams(tokens) if tokens is not None else None

    @staticmethod
    def _grams(tokens: list[list[str]]) -> Entries:
        known, code, owner = _codes(tokens)
        h, of = grams(known)
        hashes, gram = np.unique(h, return_inverse=True)
        starts = np.searchsorted(of, np.arange(len(known) + 1))
        sizes = np.diff(starts)
        spread = gram[_spread(starts[code], sizes[code])]
        return Entries(hashes, *_counted(np.repeat(owner, sizes[code]), spread, len(hashes)))


def grams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the token) of all n-grams inside the tokens, each with a space on both sides, by token."""
    c = _mix(np.frombuffer(f" {'  '.join(tokens)} ".encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1))
    owner = np.repeat(np.arange(len(tokens)), [len(w) + 2 for w in tokens]) if tokens else np.zeros(len(c), dtype=np.int64)
    out, of = [], []
    for n in range(LOW, HIGH + 1) if tokens else ():
        inside = owner[: 1 - n] == owner[n - 1 :]
        total = np.full(len(inside), n, dtype=np.uint64)
        for j in range(n):
            total += c[j : j + len(inside)] * _STEPS[j]
        out.append(_mix(total[inside]))
        of.append(owner[: 1 - n][inside])
    if not out:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.concatenate(out)[order], of[order]


def lowered(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, words): texts in lower case. Words are null where Python splits a text as the engine does; of the letters after U+086F the two
    may know different ones."""
    known = once(df.select(F.col(key).alias("key"), F.col(text).alias("_text")), "key", text=F.lower(F.coalesce("_text", F.lit(""))))
    return known.withColumn("words", F.when(F.col("text").rlike(r"[^\x00-࡯]"), F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))))


def _slices(rows: Iterator[tuple], stops: frozenset[str], chars: bool) -> Iterator[tuple[list, list[str], Slice]]:
    """(keys, texts, terms) of rows (key, text, words)."""
    keys, texts, words, tokens, size = [], [], [], [], 0
    for key, text, found in rows:
        keys.append(key)
        texts.append(text)
        words.append([w for w in (_WORD.findall(text) if found is None else found) if w not in stops])
        tokens.append(text.split() if chars else [])
        size += max(len(words[-1]), len(tokens[-1]))
        if size >= SLICE_WORDS or len(keys) == SLICE_DOCS:
            yield keys, texts, Slice(words, tokens if chars else None)
            keys, texts, words, tokens, size = [], [], [], [], 0
    if keys:
        yield keys, texts, Slice(words, tokens if chars else None)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True)


def _places(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted list, whether there) of each."""
    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    return at, known[at] == h if len(known) else np.zeros(len(h), dtype=bool)


COUNTS = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("n", T.LongType())])


def document_counts(corpus: DataFrame, own, stops: frozenset[str], chars: bool, pairs_alone: bool = False) -> DataFrame:
    """(block, h, df) of ``lowered`` texts: words and the ``own`` pairs (a broadcast variable of sorted hashes) as block 0, n-grams as block 1; with
    ``pairs_alone`` only the pairs."""
    arrow = to_arrow_schema(COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        size = 0

        def give():
            for block, parts in held.items():
                if parts:
                    h, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    n = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]), minlength=len(h)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), block, dtype=np.int32)), pa.array(h.view(np.int64)), pa.array(n)], schema=arrow)

        for _, _, s in _slices(_rows(batches), stops, chars and not pairs_alone):
            asked = _places(own.value, s.pairs.hashes)[1]
            found = [(0, s.pairs.hashes[asked], np.bincount(s.pairs.term, minlength=len(asked))[asked])]
            if not pairs_alone:
                found.append((0, s.words.hashes, np.bincount(s.words.term, minlength=len(s.words.hashes))))
            if s.grams is not None:
                found.append((1, s.grams.hashes, np.bincount(s.grams.term, minlength=len(s.grams.hashes))))
            for block, h, n in found:
                held[block].append((h, n))
                size += len(h)
            if size >= GATHERED:
                yield from give()
                held, size = {0: [], 1: []}, 0
        yield from give()

    return corpus.mapInArrow(run, COUNTS).groupBy("block", "h").agg(F.sum("n").alias("df"))


class Weights:
    """Document counts of terms, and the queries' weights by term, as tasks hold them."""

    def __init__(self, n_docs: int, counts: list[tuple[np.ndarray, np.ndarray]], all_pairs: bool = False):
        self.n_docs, self.all_pairs = n_docs, all_pairs
        order = [np.argsort(h) for h, _ in counts]
        self.hashes = [h[k] for k, (h, _) in zip(order, counts, strict=True)]
        self.df = [df[k].astype(np.int32 if n_docs < 2**31 else np.int64) for k, (_, df) in zip(order, counts, strict=True)]

    def idf(self, df: np.ndarray | int) -> np.ndarray:
        return np.log((1.0 + self.n_docs) / (1.0 + df)) + 1

    def weigh(self, s: Slice, stored: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(document, place in the list of hashes, weight before scaling, in the order of documents; shortest and greatest squared length of each
        document's vector) of each block. In ``stored`` documents a word that is not in the list is its document's own alone, and
        a pair as well if ``all_pairs`` of these documents are in it, else one of at most the documents of either word; in queries it is unknown."""
        out = []
        parts: list[list[Entries]] = [[s.words, s.pairs]] + ([[s.grams]] if s.grams is not None else [])
        for block, entries in enumerate(parts):
            docs, places, weights = [], [], []
            low, high = np.zeros(s.n_docs), np.zeros(s.n_docs)
            for e in entries:
                at, there = _places(self.hashes[block], e.hashes)
                counts = self.df[block][at] if len(self.df[block]) else np.zeros(len(at), dtype=np.int64)
                if stored and not block:
                    counts = np.where(there, counts, 1)
                    most = counts
                    if e is s.words:
                        of_words = counts
                    elif not self.all_pairs:
                        most = np.where(there, counts, np.minimum(of_words[s.left], of_words[s.right]))
                    least, greatest = self.idf(most), self.idf(counts)
                else:
                    least = greatest = np.where(there, self.idf(np.maximum(counts, 1)), 0.0)
                tf = 1 + np.log(e.n)
                low += np.bincount(e.doc, weights=(tf * least[e.term]) ** 2, minlength=s.n_docs)
                high += np.bincount(e.doc, weights=(tf * greatest[e.term]) ** 2, minlength=s.n_docs)
                kept = there[e.term]
                docs.append(e.doc[kept])
                places.append(at[e.term[kept]])
                weights.append(tf[kept] * greatest[e.term[kept]])
            doc = np.concatenate(docs)
            order = np.argsort(doc, kind="stable") if len(entries) > 1 else slice(None)
            out.append((doc[order], np.concatenate(places)[order], np.concatenate(weights)[order], low, high))
        return out

    def hold(self, queries: list[Slice]) -> None:
        """The queries' weights by term: places of the terms that some query has, and for each the queries and their weights."""
        weighed = [self.weigh(s, False) for s in queries]
        first = np.cumsum([0, *(s.n_docs for s in queries)])
        self.n_queries = int(first[-1])
        self.used, self.starts, self.query, self.weight = [], [], [], []
        lengths = [np.concatenate([w[block][4] for w in weighed]) for block in range(len(self.hashes))]
        blocks = np.sqrt(np.maximum(1, sum(x > 0 for x in lengths)))
        for block, length in enumerate(lengths):
            query = np.concatenate([w[block][0] + at for w, at in zip(weighed, first[:-1], strict=True)])
            place = np.concatenate([w[block][1] for w in weighed])
            weight = np.concatenate([w[block][2] for w in weighed]) / np.sqrt(length[query]) / blocks[query]
            order = np.argsort(place, kind="stable")
            used, start = np.unique(place[order], return_index=True)
            self.used.append(used)
            self.starts.append(np.append(start, len(place)))
            self.query.append(query[order].astype(np.int32))
            self.weight.append(weight[order])

    def scores(self, s: Slice, only: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(document, lower bounds, upper bounds) of the scores with each query of the ``only`` documents; the two are equal if all pairs are known."""
        weighed = self.weigh(s, True)
        blocks = np.sqrt(np.maximum(1, sum((x[4] > 0).astype(int) for x in weighed)))
        held = []
        for (doc, at, w, low, high), used, starts in zip(weighed, self.used, self.starts, strict=True):
            k = np.minimum(np.searchsorted(used, at), max(0, len(used) - 1))
            mine = used[k] == at if len(used) else np.zeros(len(at), dtype=bool)
            doc, k, w = doc[mine], k[mine], w[mine]
            held.append((np.searchsorted(doc, np.arange(s.n_docs + 1)), starts[k] if len(used) else k, starts[k + 1] - starts[k] if len(used) else k, w, np.sqrt(low), np.sqrt(high)))
        for d in only.tolist():
            least, most = np.zeros(self.n_queries), np.zeros(self.n_queries)
            for (bounds, start, size, w, low, high), query, weight in zip(held, self.query, self.weight, strict=True):
                a, b = bounds[d], bounds[d + 1]
                if a == b:
                    continue
                places = _spread(start[a:b], size[a:b])
                total = np.bincount(query[places], weights=np.repeat(w[a:b], size[a:b]) * weight[places], minlength=self.n_queries)
                least += total / high[d]
                most += total / low[d]
            yield d, least / blocks[d], most / blocks[d]


class Copies:
    """Whether as many copies of a text with smaller keys have been seen as are asked for: they score the same and come first."""

    def __init__(self, k: int):
        self.k, self.seen = k, {}

    def enough(self, key, text: str) -> bool:
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        keys = self.seen.setdefault(xxhash.xxh3_128_digest(text.encode()), [])
        mine = (key is not None, 0 if key is None else key)
        if len(keys) == self.k and keys[-1] < mine:
            return True
        bisect.insort(keys, mine)
        del keys[self.k :]
        return False


def candidates(corpus: DataFrame, weights, n_queries: int, k: int, key_type: T.DataType, stops: frozenset[str], chars: bool) -> DataFrame:
    """(query, key, low, high): bounds of the scores of those documents of each task whose upper bound reaches the k-th best lower bound of a query in the
    task; ``weights`` is a broadcast variable."""
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("key", key_type), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, copies = weights.value, Copies(k)
        floors = np.zeros((k, n_queries))  # the best lower bounds of each query, the k-th first
        kept: list[tuple[np.ndarray, list, np.ndarray, np.ndarray]] = []
        size = 0

        def give():
            query = np.concatenate([x[0] for x in kept])
            low, high = (np.concatenate([x[i] for x in kept]) for i in (2, 3))
            on = np.flatnonzero(high >= floors[0][query] - NEAR)
            keys = [x[1] for x in kept for _ in range(len(x[0]))]
            yield pa.RecordBatch.from_arrays([pa.array(query[on].astype(np.int32)), pa.array([keys[i] for i in on.tolist()], type=arrow.field("key").type), pa.array(low[on]), pa.array(high[on])], schema=arrow)

        for keys, texts, s in _slices(_rows(batches), stops, chars):
            only = np.array([d for d, (key, text) in enumerate(zip(keys, texts, strict=True)) if not copies.enough(key, text)], dtype=np.int64)
            for d, low, high in held.scores(s, only):
                better = np.flatnonzero((high > 0) & (high >= floors[0] - NEAR))
                if not len(better):
                    continue
                kept.append((better, keys[d], low[better], high[better]))
                size += len(better)
                floors[0, better] = np.maximum(floors[0, better], low[better])
                floors[:, better] = np.sort(floors[:, better], axis=0)
                if size >= CELLS:
                    yield from give()
                    kept, size = [], 0
        if kept:
            yield from give()

    return corpus.mapInArrow(run, schema)


def pairs_of(corpus: DataFrame, weights, stops: frozenset[str]) -> DataFrame:
    """(h): pairs of the texts that ``weights`` (a broadcast variable) has no count of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, s in _slices(_rows(batches), stops, False):
            h = s.pairs.hashes[~_places(weights.value.hashes[0], s.pairs.hashes)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return corpus.mapInArrow(run, "h long").distinct()


def _held(counts: DataFrame) -> pa.Table | None:
    """The rows, unless there are more than tasks may hold."""
    counts = counts.persist()
    try:
        return None if counts.count() > MAX_TERMS else counts.toArrow()
    finally:
        counts.unpersist()


def search(queries: DataFrame, corpus: DataFrame, k: int, query_text: str, doc_text: str, query_key: str, doc_key: str, chars: bool, stop_words: Sequence[str]) -> DataFrame | None:
    """(query_key, doc_key, score): candidates that hold the k best documents of each query; None if a bound is passed."""
    spark, stops = corpus.sparkSession, frozenset(stop_words)
    share = spark.sparkContext.broadcast
    asked = lowered(queries, query_key, query_text).take(MAX_QUERIES + 1)
    if len(asked) > MAX_QUERIES:
        return None
    slices = [s for _, _, s in _slices(((r.key, r.text, r.words) for r in asked), stops, chars)]
    if sum(len(e.doc) for s in slices for e in (s.words, s.pairs, s.grams) if e is not None) > MAX_ENTRIES:
        return None
    key_type, query_type = corpus.schema[doc_key].dataType, queries.schema[query_key].dataType
    if not asked:
        return spark.createDataFrame([], T.StructType([T.StructField(query_key, query_type), T.StructField(doc_key, key_type), T.StructField("score", T.DoubleType())]))
    rows = lowered(corpus, doc_key, doc_text)
    pairs = np.unique(np.concatenate([s.pairs.hashes for s in slices]))
    own = np.union1d(pairs, np.concatenate([s.words.hashes for s in slices])).view(np.int64)
    mine = F.broadcast(spark.createDataFrame(pa.table({"h": own, "mine": np.ones(len(own), dtype=bool)})))
    found = _held(document_counts(rows, share(pairs), stops, chars).join(mine, "h", "left").where("df > 1 or (block = 0 and mine)").select("block", "h", "df"))
    if found is None:
        return None
    block, h, df = (found[c].to_numpy() for c in ("block", "h", "df"))
    counts = [(h[block == b].view(np.uint64), df[block == b]) for b in range(2 if chars else 1)]
    n_docs = corpus.count()
    weights = Weights(n_docs, counts)
    weights.hold(slices)
    first = share(weights)
    bounded = candidates(rows, first, len(asked), k, key_type, stops, chars)
    kth = F.max(F.when(F.col("place") == k, F.col("low"))).over(W.partitionBy("query"))
    bounded = bounded.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.col("low").desc()))).withColumn("kth", F.coalesce(kth, F.lit(0.0)))
    chosen = bounded.where(F.col("high") >= F.col("kth") - NEAR).select(F.col("key").alias("chosen")).distinct().toArrow()
    chosen = spark.createDataFrame(chosen, T.StructType([T.StructField("chosen", key_type)]))
    few = rows.join(F.broadcast(chosen), F.col("key").eqNullSafe(F.col("chosen")), "left_semi")
    unknown = _held(pairs_of(few, first, stops))
    if unknown is None:
        return None
    third = share(np.sort(unknown["h"].to_numpy().view(np.uint64)))
    more = document_counts(rows, third, stops, chars, pairs_alone=True).select("h", "df").toArrow()
    counts[0] = tuple(np.concatenate([a, b]) for a, b in zip(counts[0], (more["h"].to_numpy().view(np.uint64), more["df"].to_numpy()), strict=True))
    exact = Weights(n_docs, counts, all_pairs=True)
    exact.hold(slices)
    part = candidates(few, share(exact), len(asked), k, key_type, stops, chars)
    names = spark.createDataFrame([(j, r.key) for j, r in enumerate(asked)], f"query int, name {query_type.simpleString()}")
    return part.join(F.broadcast(names), "query").select(F.col("name").alias(query_key), F.col("key").alias(doc_key), F.col("low").alias("score"))
