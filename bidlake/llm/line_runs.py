"""Operator 6: repeated line runs from a suffix array by distributed prefix doubling.

Lines become ids, documents sequences of ids. Lines that occur once cannot be part of a
repeated run, so sequences are the stretches of repeated lines with enough words.
Round k sorts the pairs (rank of the first 2^k lines, rank of the next 2^k) of all
suffixes by range partitions and gives each pair that occurs twice or more its place
in that order as rank for 2^(k+1) lines. A rank names an interval of the suffix array
whose suffixes have a longest common prefix of that many lines at least, and the two
ranks of overlapping powers of two name the interval of a run of any length.

A run counts if it has ``min_words`` words. Every run with an earlier copy is the union of
its shortest such runs from each start and to each end, so it is enough to look those up:
their interval's smallest (document, hash of its text, line) is the copy that stays, all others are
deleted, and what they cover together are the maximal repeated runs. A shortest run has
``min_words`` lines at most, which bounds the rounds by log2 of it.

Hot lines: pairs are pre-aggregated before each shuffle, sorting spreads by range over
distinct pairs, and joins back broadcast the few hot groups (``common.join_back``).

Defined results: null and empty texts and lines without words are no units; rows with a
null id are left out; rows that repeat an id and its text are one document and get equal results, rows
that repeat an id with another text are documents of their own, so (id, hash of the text, line) has no
ties; texts of any length are read whole; empty input gives no rows. Only the id and text columns are
read, so extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_back, map_rows, materialize, schema_of
from .units import DOC, MIN_WORDS, cut_runs, line_units, repeated, stretch_of

RUNS = schema_of(doc_id="long", key="long", first="int", last="int", length="int", a="long", b="long")


def ranked(keys: DataFrame, *by: str) -> DataFrame:
    """Distinct keys with ``rank``, a number that grows with their order.

    A range sort puts partitions in order; the number is made of the partition and the place
    in it. Checkpointed, so the numbers stay if a task runs again.
    """
    return materialize(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()))


def stretches(units: DataFrame, min_words: int) -> DataFrame:
    """Repeated lines in stretches with enough words: doc_id, key, stretch, seq, words, start, end, r0."""
    ids = ranked(repeated(units, "h1", "h2").drop("first"), "h1", "h2").withColumnRenamed("rank", "r0")
    lines = join_back(units, ids, "h1", "h2").drop("h1", "h2").distinct()
    lines = lines.withColumn("stretch", stretch_of())
    total = F.sum("words").over(W.partitionBy(*DOC, "stretch"))
    return materialize(lines.withColumn("total", total).where(F.col("total") >= min_words).drop("total"))


def double(lines: DataFrame, k: int) -> DataFrame:
    """One more rank: r<k+1> of the 2^(k+1) lines from each line on, null if no other suffix has them."""
    old, new = f"r{k}", f"r{k + 1}"
    order = W.partitionBy(*DOC, "stretch").orderBy("seq")
    paired = lines.withColumn("next", F.lead(old, 2**k).over(order))
    pairs = paired.where(F.col(old).isNotNull() & F.col("next").isNotNull())
    ranks = ranked(pairs.groupBy(old, "next").agg(F.count("*").alias("n")).where("n > 1"), old, "next").withColumnRenamed("rank", new)
    known = join_back(pairs.select(*DOC, "seq", old, "next"), ranks, old, "next").select(*DOC, "seq", new)
    return materialize(lines.join(known, [*DOC, "seq"], "left"))


def _shortest(min_words: int, n_ranks: int):
    def rows(doc_id, key, lines):
        lines = sorted(lines, key=lambda x: x["seq"])
        words = [x["words"] for x in lines]
        n = len(lines)
        wanted = set()
        end, total = 0, 0
        for s in range(n):  # shortest from each start
            while end < n and total < min_words:
                total += words[end]
                end += 1
            if total < min_words:
                break
            wanted.add((s, end))
            total -= words[s]
        start, total = 0, 0
        for e in range(n):  # shortest to each end
            total += words[e]
            while total - words[start] >= min_words:
                total -= words[start]
                start += 1
            if total >= min_words:
                wanted.add((start, e + 1))
        for s, e in sorted(wanted):
            k = (e - s).bit_length() - 1
            if k >= n_ranks:
                continue
            a, b = lines[s][f"r{k}"], lines[e - 2**k][f"r{k}"]
            if a is not None and b is not None:
                yield doc_id, key, lines[s]["seq"], lines[e - 1]["seq"], e - s, a, b

    return rows


def _kernel(min_words: int, n_ranks: int):
    def build():
        return _shortest(min_words, n_ranks)

    return build


def later_runs(lines: DataFrame, min_words: int, n_ranks: int) -> DataFrame:
    """Shortest runs that have an earlier copy: doc_id, key, first, last, first_doc."""
    ranks = [f"r{k}" for k in range(n_ranks)]
    by_stretch = lines.groupBy(*DOC, "stretch").agg(F.collect_list(F.struct("seq", "words", *ranks)).alias("lines"))
    runs = materialize(map_rows(by_stretch.select(*DOC, "lines"), _kernel(min_words, n_ranks), RUNS, many=True))
    place, run = F.struct(*DOC, "first"), ["length", "a", "b"]
    groups = runs.groupBy(*run).agg(F.count("*").alias("n"), F.min(place).alias("lo"), F.max(place).alias("hi")).where(F.col("lo") < F.col("hi")).drop("hi")
    # the first of the columns is the one by which hot rows are dealt out
    back = join_back(runs, groups, "a", "b", "length")
    return back.where(place > F.col("lo")).select(*DOC, "first", "last", F.col("lo.doc_id").alias("first_doc"))


def _merge():
    def rows(doc_id, key, runs) -> Iterator[tuple]:
        at = None
        for r in sorted(runs, key=lambda r: (r["first"], r["last"])):
            if at is not None and r["first"] <= at[1] + 1:
                at = (at[0], max(at[1], r["last"]), min(at[2], r["first_doc"]))
            else:
                if at is not None:
                    yield (doc_id, key, *at)
                at = (r["first"], r["last"], r["first_doc"])
        if at is not None:
            yield (doc_id, key, *at)

    return rows


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per maximal run of lines to delete: doc_id, key, first_line, last_line (numbers among
    lines with words), code points [start, end), n_words and the smallest document with a copy."""
    units = materialize(line_units(docs, id_col, text_col))
    lines = stretches(units, min_words)
    n_ranks = 1
    while 2**n_ranks <= min_words:
        if lines.where(F.col(f"r{n_ranks - 1}").isNotNull()).isEmpty():
            break
        lines = double(lines, n_ranks - 1)
        n_ranks += 1
    later = later_runs(lines, min_words, n_ranks)
    merged = map_rows(
        later.groupBy(*DOC).agg(F.collect_set(F.struct("first", "last", "first_doc")).alias("runs")), _merge,
        schema_of(doc_id="long", key="long", first_line="int", last_line="int", first_doc_id="long"), many=True,
    )
    covered = merged.withColumn("seq", F.explode(F.sequence("first_line", "last_line")))
    places = lines.select(*DOC, "seq", "words", "start", "end")
    return (
        covered.join(places, [*DOC, "seq"])
        .groupBy(*DOC, "first_line", "last_line", "first_doc_id")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").cast("long").alias("n_words"))
    )


def remove_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those runs, with all their columns."""
    return cut_runs(docs, repeated_runs(docs, min_words, id_col, text_col), id_col, text_col)
