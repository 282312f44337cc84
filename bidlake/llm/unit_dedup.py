"""Operator 4: substring dedup by hashed units.

Units are normalised (white space folded), their digests grouped globally, and the earliest ranked
occurrence of each kept: the smallest (document id, hash of the text, place). Later ones are removed
where they stand, by their offsets in the original text. There are units of three sizes:

- whole texts: a text that an earlier document has too is one passage, and nothing else of it is looked at;
- lines: marked neighbours make a passage if they have ``min_words`` words together (``later_copies``
  returns every later copy of a line, however short);
- stretches of ``PASSAGE`` words from any word on, so that passages inside lines are found to the word. Hashing
  all of them would take a row a word. Instead each text is first sampled: of every ``SPAN`` neighbouring
  word sequences of ``ANCHOR`` words the one with the smallest hash is an anchor (winnowing), so a
  passage that stands twice has an anchor that stands twice. Only the stretches around
  repeated anchors are hashed and grouped; the result is the same as if all were.

Counting is pre-aggregated before each shuffle, and joins back to the groups broadcast the
few hot ones (``common.join_back``), so a passage that a third of all documents share stays spread.

Defined results: null and empty texts and lines without words have no units; rows with a
null id have none; rows that repeat an id and its text are one document and get equal results;
rows that repeat an id with another text are documents of their own; very long texts are worked through
whole; empty input gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Rolling, WordHash, join_back, keyed_bytes, map_rows, materialize, mix64, schema_of, small, utf8
from .units import DOC, MIN_WORDS, _units, cut_runs, later_units, line_units, place, runs_of, stretch_of

#: Words of a passage inside lines ("over 50"), of an anchor, and the sequences of which one at least is an anchor.
PASSAGE, ANCHOR, SPAN = 51, 16, 36
#: Bases of the window hashes; any odd numbers.
BASE_1, BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

MEASURED = schema_of(
    doc_id="long", key="long", words="array<int>", start="array<int>", end="array<int>", h1="array<long>", h2="array<long>", at="array<int>", anchors="array<long>",
)
STRETCHES = schema_of(rank="long", seq="array<int>", start="array<int>", end="array<int>", h1="array<long>", h2="array<int>", again="array<boolean>")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line that stands earlier too, however short: doc_id, line, code points [start, end), words, the document
    with its earliest copy, and whether the line is part of a passage of at least ``min_words`` words (which is removed)."""
    rows = later_units(line_units(docs, id_col, text_col)).withColumn("run", stretch_of())
    in_passage = F.sum("words").over(W.partitionBy(*DOC, "run")) >= min_words
    return rows.select("doc_id", F.col("seq").alias("line"), "start", "end", F.col("words").alias("n_words"), F.col("first_doc").alias("first_doc_id"), in_passage.alias("in_passage"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage of whole lines to remove: doc_id, lines, code points [start, end), words, and the
    document that keeps its first line's earliest copy."""
    return runs_of(later_units(materialize(line_units(docs, id_col, text_col))), min_words)


def _measure_text():
    def row(doc_id, key, body):
        words = body.split() if body else []
        if not words:
            return doc_id, key, 0, 0, 0
        text = utf8(body)
        start = len(text) - len(text.lstrip(SPACES))
        return doc_id, key, len(words), start, len(text.rstrip(SPACES))

    return row


SPACES = " \t\n\r\x0b\x0c"
WHOLE = schema_of(doc_id="long", key="long", n_words="long", start="long", end="long")


def copied_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, first_doc_id): documents whose text is that of an earlier one, byte by byte. The
    digests are taken where the rows stand, and rows travel as digests."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("binary")).alias("key"), F.sha2(F.col(text_col).cast("binary"), 256).alias("digest"))
    rows = rows.where("doc_id is not null and digest is not null")
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(*DOC)).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last").drop("last")
    back = join_back(rows, groups, "digest").where(F.struct(*DOC) > F.col("first"))
    return back.select(*DOC, F.col("first.doc_id").alias("first_doc_id")).distinct()


def anchors_of(words: list[bytes], hashes: WordHash, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors: in any ``SPAN`` neighbouring sequences the smallest, all of them at ties."""
    h = rolling.windows(hashes.of(words), ANCHOR)
    if len(h) < SPAN:
        return np.zeros(0, dtype=np.int64), h[:0]
    least = _slide(h, SPAN, np.minimum)
    # a sequence is the smallest of a window if the greatest of the minima of its windows is its own hash
    pad = np.zeros(SPAN - 1, dtype=np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), SPAN, np.maximum)
    at = np.flatnonzero(most == h)
    return at, h[at]


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """The best of every ``width`` neighbours, in log2(width) steps."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = best(out[: len(out) - step], out[step:])
        done += step
    return out


def _measure():
    """Kernel: the line units of a text as arrays, and its anchors."""
    hashes, rolling, lines = WordHash(), Rolling(BASE_1), _units()

    def row(doc_id, key, body):
        units = list(zip(*lines(doc_id, key, body), strict=True)) or [()] * 8
        words = body.split() if body and doc_id is not None else []
        at, h = anchors_of(words, hashes, rolling) if len(words) >= PASSAGE else (np.zeros(0, dtype=np.int64),) * 2
        return doc_id, key, *units[3:], at.tolist(), h.view(np.int64).tolist()

    return row


def _stretches(rank, body, near, hashes: WordHash, one: Rolling, two: Rolling) -> tuple:
    """A row of STRETCHES: the stretches that hold one of the anchors at ``near``, and whether each stands
    earlier in the same text."""
    words = body.split()
    last = len(words) - PASSAGE + 1
    wanted = np.zeros(last + 1, dtype=np.int64)
    at = np.array(near, dtype=np.int64)
    np.add.at(wanted, np.maximum(0, at + ANCHOR - PASSAGE), 1)
    np.add.at(wanted, np.minimum(at + 1, last), -1)
    wanted = np.flatnonzero(np.cumsum(wanted[:-1]))
    h = hashes.of(words)
    h1, h2 = one.windows(h, PASSAGE)[wanted].view(np.int64), (two.windows(mix64(h), PASSAGE)[wanted] >> np.uint64(33)).astype(np.int32)
    order = np.lexsort((wanted, h2, h1))
    again = np.zeros(len(wanted), dtype=bool)
    again[order[1:]] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
    starts, ends = word_places(body, words)
    return rank, wanted.tolist(), starts[wanted].tolist(), ends[wanted + PASSAGE - 1].tolist(), h1.tolist(), h2.tolist(), again.tolist()


def word_places(body: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points at which each word starts and ends."""
    raw = np.frombuffer(body, dtype=np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if body.isascii():
        return starts, ends
    text = utf8(body)
    if len(text.encode("utf-8")) != len(body) or "�" in text:  # bytes that are no UTF-8: count what they decode to
        at = {}
        done = 0
        for b in sorted({*starts.tolist(), *ends.tolist()}):
            at[b] = done = len(utf8(body[:b]))
        return np.array([at[b] for b in starts.tolist()]), np.array([at[b] for b in ends.tolist()])
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points[starts], points[ends]


def _stretcher():
    return partial(_stretches, hashes=WordHash(), one=Rolling(BASE_1), two=Rolling(BASE_2))


def repeated_stretches(texts: DataFrame, measured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every stretch of ``PASSAGE`` words that stands earlier too, as (rank, seq, start, end, first): the rank of
    its document, its first word, code points and the rank of the first document that has it; and the ranks
    (doc_id, key, rank). ``texts`` are keyed, ``measured`` has anchors of those that count."""
    numbered = measured.select(*DOC, "at", "anchors", F.monotonically_increasing_id().alias("doc"))  # the same at each reading of the checkpoint
    places = numbered.select("doc", F.explode(F.arrays_zip("at", "anchors")).alias("x")).select("doc", F.col("x.at").alias("seq"), F.col("x.anchors").alias("h"))
    groups = places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    near = join_back(places, groups, "h").groupBy("doc").agg(F.collect_set("seq").alias("near"))
    near = near.join(numbered.select(*DOC, "doc"), "doc").groupBy(*DOC).agg(F.first("near").alias("near"))
    ranks = materialize(near.repartitionByRange(*DOC).sortWithinPartitions(*DOC).withColumn("rank", F.monotonically_increasing_id()))
    found = texts.join(ranks.withColumnRenamed("key", "k"), (F.col("id") == F.col("doc_id")) & (F.col("key") == F.col("k"))).select("rank", "body", "near")
    held = materialize(map_rows(found, _stretcher, STRETCHES))
    rows = held.select("rank", F.explode(F.arrays_zip("seq", "start", "end", "h1", "h2", "again")).alias("x")).select("rank", "x.*")
    once = rows.where("not again").drop("again")
    groups = once.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("rank").alias("first")).where("n > 1")
    later = join_back(once, groups, "h1", "h2").where("rank > first").select("rank", "seq", "start", "end", "first")
    within = rows.where("again").select("rank", "seq", "start", "end", F.col("rank").alias("first"))
    return later.unionByName(within), ranks.select(*DOC, "rank")


def passages_in_text(stretches: DataFrame, ranks: DataFrame) -> DataFrame:
    """Stretches that overlap or meet as one passage each: doc_id, key, code points, words, first document."""
    order = W.partitionBy("rank").orderBy("seq")
    fresh_one = F.col("seq") > F.coalesce(F.lag("seq").over(order), F.lit(-PASSAGE - 1)) + PASSAGE
    runs = stretches.withColumn("starts", fresh_one.cast("int")).withColumn("run", F.sum("starts").over(order))
    runs = runs.groupBy("rank", "run").agg(
        F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), (F.max("seq") - F.min("seq") + PASSAGE).cast("long").alias("n_words"), F.min("first").alias("first")
    )
    firsts = ranks.select(F.col("rank").alias("first"), F.col("doc_id").alias("first_doc_id"))
    return runs.join(ranks, "rank").join(firsts, "first").select(*DOC, "start", "end", "n_words", "first_doc_id")


def passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage to remove: doc_id, key, unit (text, lines or words), code points [start, end), n_words and
    the smallest document with an earlier copy of one of its units. Passages of different units may overlap."""
    copied = materialize(copied_texts(docs, id_col, text_col))
    known = small(copied)
    texts = keyed_bytes(docs, id_col, text_col)
    same = (F.col("id") == F.col("doc_id")) & (texts["key"] == known["key"])
    whole = map_rows(texts.join(known, same, "left_semi"), _measure_text, WHOLE).distinct().where(f"n_words >= {min_words}")
    whole = whole.join(known, list(DOC)).select(*DOC, F.lit("text").alias("unit"), "start", "end", "n_words", "first_doc_id")
    measured = materialize(map_rows(texts, _measure, MEASURED).where("size(words) > 0").join(known, list(DOC), "left_anti"))
    # ints in the arrays keep the checkpoint small
    units = measured.select(*DOC, F.posexplode(F.arrays_zip("words", "start", "end", "h1", "h2")).alias("seq", "x")).selectExpr(*DOC, "seq", "x.words", "bigint(x.start) start", "bigint(x.end) end", "x.h1", "x.h2")
    lines = runs_of(later_units(units), min_words).select(*DOC, F.lit("lines").alias("unit"), "start", "end", "n_words", "first_doc_id")
    words = passages_in_text(*repeated_stretches(texts, measured)).select(*DOC, F.lit("words").alias("unit"), "start", "end", "n_words", "first_doc_id")
    return whole.unionByName(lines).unionByName(words)


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those passages, with all their columns; those of which nothing is left go."""
    return cut_runs(docs, passages(docs, min_words, id_col, text_col), id_col, text_col)
