"""Operator 12: exact ranked search by three-phase uniform thresholds (TPUT) over postings by term.

1. *Heads.* Every term's list gives its k highest impacts; their sums by item and document are
   lower bounds, and the k-th of them, divided by the item's number of terms, is the
   uniform threshold. The best documents of the heads are also scored exactly, which lifts the lower bound
   that candidates must reach.
2. *Uniform threshold.* Every list gives all its impacts from the threshold on. What a list keeps back
   is below the threshold and no more than the list's own greatest impact, so each
   document has an upper bound, and those under the lower bound go.
3. *Look-up.* Full scores of the candidates that are left, from the lists.

The lists are written once, dealt by ranges of (term, impact) and sorted, so a common word's list lies in
many files. In phase 2 the entries that pass travel to their document's partition before they
meet the items, and are added up there, in blocks of documents by items; the only other shuffles are of heads,
bounds and candidates. Items beyond a bound on their words meet the entries in joins instead.

Terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. Impacts are whole 64-bit numbers.

Defined results: null and empty texts hold no terms, and a document without terms does not count in N; an item without known terms
gives no rows; every row of either table is a document or item of its own, so rows that repeat an id are
ranked each, and a null id ranks after the others of its score; texts are read whole; an empty table gives no
rows. Only ids and texts are read.
"""

from __future__ import annotations

import itertools
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import alnum_words, begin, give_back, map_rows, materialize, resident, schema_of, shared_folder, small

#: Bytes of the items' words up to which tasks hold them and index no others.
VOCABULARY_BYTES = 16_000_000
#: Best documents of the heads that are scored exactly for the lower bound, as a multiple of k.
HEADS_SCORED = 4
#: Rows of items and terms up to which tasks hold them (some 10 MB) and add up in blocks of ``DOCS`` documents by ``TILE`` items.
ASKED_ROWS, DOCS, TILE = 200_000, 1024, 512

COUNTS = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("tfs", T.ArrayType(T.LongType())),
])


def term_counts(docs: DataFrame, id_col: str, text_col: str, wanted: frozenset[bytes] | None = None) -> DataFrame:
    """(doc, doc_id, n, terms, tfs): the number of all terms of each row that has any, and the counts of the ``wanted``."""
    token = uuid.uuid4().hex

    def kernel():
        keep = resident(("terms", token), lambda: wanted)

        def count(doc, doc_id, body):
            words = alnum_words(body)
            if not words:
                return
            found = Counter(words)
            terms = sorted(found) if keep is None else sorted(found.keys() & keep)
            yield doc, doc_id, len(words), terms, [found[t] for t in terms]

        return count

    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    return map_rows(rows, kernel, COUNTS, many=True)


def build_index(docs: DataFrame, folder: str, wanted: frozenset[bytes] | None = None, semi: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Writes below ``folder`` and reads again: (doc, doc_id, …) of all rows with terms, the lists (t, impact, doc), and the
    terms (term, t) by whose numbers the lists go.

    ``wanted`` (a set of known size) or ``semi`` (a table of terms) leaves out lists that nothing will ask for; counts
    and lengths are those of all terms in any case."""
    spark = docs.sparkSession
    term_counts(docs, id_col, text_col, wanted).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    n_docs, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    entries = counts.select("doc", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("e")).select("doc", "n", F.col("e.terms").alias("term"), F.col("e.tfs").alias("tf"))
    if semi is not None:
        entries = entries.join(small(semi), "term", "left_semi")
    weights = entries.groupBy("term").agg(F.count("*").alias("df")).select("term", F.monotonically_increasing_id().alias("t"), weight(n_docs, F.col("df")).alias("w"))
    weights = materialize(weights)
    length = F.lit(50) + F.expr(f"(50L * n * {n_docs}L) div {max(1, n_terms)}L")
    lists = entries.join(small(weights), "term").select("t", impact(F.col("w"), F.col("tf"), length).alias("impact"), "doc").where("impact > 0")
    lists.repartitionByRange("t", F.desc("impact"), "doc").sortWithinPartitions("t", F.desc("impact"), "doc").write.parquet(f"{folder}/lists")
    return counts, spark.read.parquet(f"{folder}/lists"), weights.select("term", "t")


def weight(n_docs: int, df: Column) -> Column:
    return F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * df + 1).cast("double"))).cast("long")


def impact(w: Column, tf: Column, length: Column) -> Column:
    """What a term adds to a document's score."""
    return w * F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, 1000 * tf + 20 * length)


def first_k(rows: DataFrame, by: str, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first rows of each key; Spark cuts each partition to k rows a key before it shuffles."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


def kth(sums: DataFrame, k: int, name: str) -> DataFrame:
    """(item, the k-th highest sum), for items that have k."""
    return first_k(sums, "item", k, F.desc("s")).where(F.col("rank") == k).select("item", F.col("s").alias(name))


def exact(lists: DataFrame, wanted: DataFrame, pairs: DataFrame) -> DataFrame:
    """(item, doc, s) for the pairs, from the lists."""
    return lists.join(small(pairs), "doc").join(small(wanted), ["item", "t"]).groupBy("item", "doc").agg(F.sum("impact").alias("s"))


def heads_of(lists: DataFrame, k: int) -> DataFrame:
    """The k highest impacts of each list. Files are sorted, so the first k of a list in any stretch of them are its best there."""
    schema = lists.select("t", "impact", "doc").schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            t = batch.column(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, dtype=np.int64)
            place = np.arange(len(t)) - np.repeat(starts, np.diff(np.append(starts, len(t))))
            kept = batch.filter(pa.array(place < k))
            yield pa.RecordBatch.from_arrays(kept.columns, schema=arrow)
        give_back()

    best = lists.select("t", "impact", "doc").mapInArrow(run, schema)
    return first_k(best, "t", k, F.desc("impact"), F.asc("doc")).select("t", "impact", "doc")


class Asked:
    """What tasks know of the items: for each term's number the items that ask for it, their thresholds and caps."""

    def __init__(self, asked: list, rest: list):
        # (item, t, threshold, cap) and (item, rest, bound)
        self.items = np.array([r[0] for r in rest], dtype=np.int64)
        at = {r[0]: k for k, r in enumerate(rest)}
        self.rest, self.bound = np.array([r[1] for r in rest], dtype=np.int64), np.array([r[2] for r in rest], dtype=np.int64)
        by_term: dict[int, list] = {}
        for item, t, threshold, cap in asked:
            by_term.setdefault(t, []).append((at[item], threshold, cap))
        self.terms = {t: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for t, rows in by_term.items()}

    def sums(self, t: np.ndarray, impact: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """item, doc, sum and upper bound of the pairs that stay, of a block of whole documents."""
        docs, row = np.unique(doc, return_inverse=True)
        found = []
        order = np.argsort(t, kind="stable")
        t, impact, row = t[order], impact[order], row[order]
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        ends = np.append(starts[1:], len(t))
        for low in range(0, len(self.items), TILE):
            high = min(low + TILE, len(self.items))
            s, over = (np.zeros((len(docs), high - low), dtype=np.int64) for _ in range(2))
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                column, threshold, cap = self.terms[int(t[a])]
                if len(self.items) > TILE:
                    mine = (column >= low) & (column < high)
                    column, threshold, cap = column[mine], threshold[mine], cap[mine]
                    if not len(column):
                        continue
                value = impact[a:b, None]
                passes = value >= threshold
                at = np.ix_(row[a:b], column - low)
                s[at] += np.where(passes, value, 0)
                over[at] += np.where(passes, value - cap, 0)
            most = over + self.rest[low:high]
            r, c = np.nonzero((s > 0) & (most >= self.bound[low:high]))
            found.append((self.items[low:high][c], docs[r], s[r, c], most[r, c]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


SEEN = schema_of(item="long", doc="long", s="long", most="long")


def _summed(passing: DataFrame, held: Asked) -> DataFrame:
    """Phase 2 in blocks of documents by items; ``passing`` (t, impact, doc) is dealt and sorted by document."""
    arrow, token = to_arrow_schema(SEEN), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        asked = resident(("asked", token), lambda: held)

        def block(parts: list[np.ndarray]) -> pa.RecordBatch:
            t, impact, doc = np.concatenate(parts, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in asked.sums(t, impact, doc)], schema=arrow)

        parts, size, docs = [], 0, 0
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            while rows.shape[1]:
                cuts = np.flatnonzero(rows[2][1:] != rows[2][:-1]) + 1
                if parts and parts[-1][2, -1] != rows[2, 0]:
                    cuts = np.concatenate([[0], cuts])
                enough = cuts[max(0, DOCS - docs - 1) :]  # a document's rows stay together
                if not len(enough):
                    parts.append(rows)
                    docs += len(cuts) + (not docs)
                    break
                if enough[0]:
                    parts.append(rows[:, : enough[0]])
                yield block(parts)
                rows, parts, docs = rows[:, enough[0] :], [], 0
        if parts:
            yield block(parts)
        give_back()

    return passing.mapInArrow(run, SEEN)


def search(lists: DataFrame, wanted: DataFrame, k: int = 50) -> DataFrame:
    """The k best documents of each item as (item, doc, s, rank), and all documents of the k-th one's score:
    the caller, who knows the documents' ids, breaks those ties. ``wanted`` (item, t) is a checkpointed table without repeats."""
    heads = materialize(heads_of(lists, k).join(small(wanted.select("t").distinct()), "t", "left_semi"))
    sizes = heads.groupBy("t").agg(F.max("impact").alias("most"))
    known = materialize(wanted.join(sizes, "t"))  # terms that some document holds
    sums = materialize(known.select("item", "t").join(heads, "t").groupBy("item", "doc").agg(F.sum("impact").alias("s")))
    lower = kth(sums, k, "lower")
    best = materialize(first_k(sums, "item", HEADS_SCORED * k, F.desc("s"), F.asc("doc")).select("item", "doc"))
    lifted = kth(exact(lists, known.select("item", "t"), best), k, "lifted")
    m = known.groupBy("item").agg(F.count("*").alias("m"))
    bounds = m.join(lower, "item", "left").join(lifted, "item", "left").select(
        "item", F.greatest(F.lit(1).cast("long"), F.ceil(F.coalesce("lower", F.lit(0)) / F.col("m")).cast("long")).alias("threshold"),
        F.greatest(F.coalesce("lower", F.lit(0)), F.coalesce("lifted", F.lit(0))).alias("bound"))
    # what a list that has not named a document can still add: below the threshold, and no more than its head
    asked = known.join(bounds, "item").select("item", "t", "threshold", F.least(F.col("threshold") - 1, "most").alias("cap"), "bound")
    asked = materialize(asked)
    rest = asked.groupBy("item").agg(F.sum("cap").alias("rest"), F.max("bound").alias("bound"))

    lowest = materialize(asked.groupBy("t").agg(F.min("threshold").alias("lowest")))
    passing = lists.join(small(lowest), "t").where("impact >= lowest").select("t", "impact", "doc")
    few = asked.count() <= ASKED_ROWS
    if few:
        passing = passing.repartition("doc").sortWithinPartitions("doc")
        seen = _summed(passing, Asked(asked.select("item", "t", "threshold", "cap").collect(), rest.select("item", "rest", "bound").collect()))
    else:
        seen = passing.join(asked, "t").where("impact >= threshold")
        seen = seen.groupBy("doc", "item").agg(F.sum("impact").alias("s"), F.sum(F.col("impact") - F.col("cap")).alias("over"))
        seen = seen.join(rest, "item").where("over + rest >= bound").select("item", "doc", "s", (F.col("over") + F.col("rest")).alias("most"))
    seen = materialize(seen)
    refined = kth(seen, k, "refined")
    candidates = materialize(seen.join(F.broadcast(refined) if few else refined, "item", "left").where("most >= coalesce(refined, 0)").select("item", "doc"))

    scores = exact(lists, known.select("item", "t"), candidates)
    ranked = scores.withColumn("rank", F.rank().over(W.partitionBy("item").orderBy(F.desc("s"))))
    return ranked.where(F.col("rank") <= k)


def words_of(queries: DataFrame, text_col: str) -> DataFrame:
    """(item, term): the distinct terms of each row of ``queries`` (item, …)."""

    def kernel():
        return lambda item, body: [(item, t) for t in set(alnum_words(body))]

    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("term", T.BinaryType())])
    return map_rows(queries.select("item", F.col(text_col).cast("binary").alias("body")), kernel, schema, many=True)


def vocabulary(wanted: DataFrame) -> frozenset[bytes] | None:
    """All terms asked for, or None if they pass ``VOCABULARY_BYTES``; read no further than that."""
    terms = wanted.select("term").distinct()
    if (terms.agg(F.sum(F.length("term") + 64)).first()[0] or 0) > VOCABULARY_BYTES:
        return None
    return frozenset(bytes(r.term) for r in itertools.chain(terms.toLocalIterator()))


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``queries`` the k documents of highest score above 0, all if
    there are fewer; equal scores by ascending id. Lists live in the shared folder while the job runs."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}"
    items = materialize(queries.select(F.monotonically_increasing_id().alias("item"), F.col(query_id).cast("long").alias("item_id"), F.col(query_text).alias("text")))
    wanted = materialize(words_of(items, "text"))
    held = vocabulary(wanted)
    counts, lists, terms = build_index(docs, folder, held, wanted.select("term").distinct() if held is None else None, id_col, text_col)
    found = search(lists, materialize(wanted.join(small(terms), "term").select("item", "t")), k).select("item", "doc", F.col("s").alias("score"))
    # ties of the k-th score are settled by the ids, which the lists do not hold
    named = counts.select("doc", "doc_id").join(small(materialize(found)), "doc")
    ranked = first_k(named, "item", k, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("doc"))
    out = materialize(ranked.join(small(items.select("item", "item_id")), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    drop(spark, folder)
    return out


def drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
