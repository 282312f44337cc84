"""Lines of texts as units with digests and offsets, for operators 4 and 6.

A document is known by its id and the hash of its text (``common.keyed_bytes``), and documents rank by
both. Rows that repeat both are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_back, keyed_bytes, map_rows, schema_of, utf8
from .stages import edit_texts

UNITS = schema_of(doc_id="long", key="long", seq="int", words="int", start="long", end="long", h1="long", h2="long")
#: Words that a passage of repeated lines must have at least to be removed.
MIN_WORDS = 50
#: What a document is known by, and the place of one of its lines, which ranks it.
DOC = ("doc_id", "key")


def place(seq: str = "seq"):
    return F.struct(*DOC, seq)


def _units():
    import xxhash

    def rows(doc_id, key, body):
        if doc_id is None or not body:
            return []
        out, at, seq = [], 0, 0
        ascii_only = body.isascii()
        for line in body.split(b"\n"):
            size = len(line) if ascii_only else len(utf8(line))
            words = line.split()
            if words:
                digest = xxhash.xxh3_128_intdigest(b" ".join(words))
                h1, h2 = digest >> 64, digest & 0xFFFFFFFFFFFFFFFF
                out.append((doc_id, key, seq, len(words), at, at + size, h1 - (1 << 63), h2 - (1 << 63)))
                seq += 1
            at += size + 1
        return out

    return rows


def line_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line with a word: its number among such lines, its words, its code points
    [start, end) in the text and the 128-bit digest of its words put apart by one space."""
    return map_rows(keyed_bytes(docs, id_col, text_col), _units, UNITS, many=True)


def repeated(units: DataFrame, *digest: str) -> DataFrame:
    """(digests, n, first): units that stand at two places or more, how often, and the first place."""
    groups = units.groupBy(*digest).agg(F.count("*").alias("n"), F.min(place()).alias("first"), F.max(place()).alias("last"))
    return groups.where(F.col("first") < F.col("last")).drop("last")


def stretch_of():
    """A number that neighbouring lines share. Repeated rows have equal places, hence ``dense_rank``."""
    return F.col("seq") - F.dense_rank().over(W.partitionBy(*DOC).orderBy("seq"))


def later_units(units: DataFrame) -> DataFrame:
    """Units that stand earlier too, with the document of the first place."""
    back = join_back(units, repeated(units, "h1", "h2"), "h1", "h2")
    return back.where(place() > F.col("first")).select(*DOC, "seq", "words", "start", "end", F.col("first.doc_id").alias("first_doc")).distinct()


def runs_of(rows: DataFrame, min_words: int) -> DataFrame:
    """Rows (doc_id, key, seq, words, start, end, first_doc) to maximal runs of neighbours with enough words.

    ``first_doc`` is the smallest of the run's.
    """
    return (
        rows.withColumn("run", stretch_of())
        .groupBy(*DOC, "run")
        .agg(
            F.min("seq").alias("first_line"), F.max("seq").alias("last_line"), F.min("start").alias("start"), F.max("end").alias("end"),
            F.sum("words").cast("long").alias("n_words"), F.min("first_doc").alias("first_doc_id"),
        )
        .where(F.col("n_words") >= min_words)
        .drop("run")
    )


def _cut(body: bytes, spans: list) -> bytes | None:
    """The text without the spans and, for each, one white-space character beside it (the one before it where
    a span ends a line that goes on before it, else the one after it); None if nothing but white space is left."""
    text = utf8(body)
    out, at = [], 0
    for a, b in _union((s["start"], s["end"]) for s in spans):
        if b < len(text) and (text[b] != "\n" or a == 0 or text[a - 1] == "\n"):
            b += 1
        elif a > at:
            a -= 1
        out.append(text[at:a])
        at = max(at, b)
    out.append(text[at:])
    left = "".join(out)
    return left.encode("utf-8") if left.strip() else None


def _union(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def cut_runs(docs: DataFrame, runs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the runs; documents of which nothing but white space is left go. Documents
    with no run pass as they are, empty ones too, and repeated rows stay as many as they are."""
    spans = runs.groupBy(*DOC).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return edit_texts(docs, spans, id_col, text_col, _cut)
