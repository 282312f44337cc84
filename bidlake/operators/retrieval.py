"""Text retrieval by TF-IDF (DOM-20, DOM-28, FN-18, JOIN-13, TOP-4, AGG-23)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import sparse_search

# Trade abbreviations, and the units that sizes are written in.
ABBREVIATIONS = {
    "ms": "iron non-alloy steel", "mild steel": "iron non-alloy steel", "gi": "galvanised zinc coated iron non-alloy steel", "ss": "stainless steel",
    "cr": "cold-rolled", "hr": "hot-rolled", "tmt": "bars rods iron non-alloy steel", "erw": "welded tubes pipes", "ci": "cast iron",
    "ht": "high tensile", "pvc": "polyvinyl chloride plastics", "hdpe": "polyethylene plastics", "ldpe": "polymers of ethylene",
    "pp": "polymers of propylene", "opc": "portland cement", "bwr": "plywood", "mcb": "automatic circuit breakers",
    "led": "light-emitting diode lamps", "hss": "tools high speed steel", "sqmm": "insulated electric conductors cable",
    "ro": "water filtering purifying", "cctv": "television cameras", "dg": "generating sets", "sae": "lubricating oils petroleum", "ctc": "tea",
    "atta": "wheat flour", "dal": "dried leguminous vegetables", "toor": "pigeon peas", "almirah": "metal furniture", "gunny": "sacks bags", "emery": "abrasive",
}
SIZE_UNITS = "mm|cm|m|inch|in|kg|g|l|ltr|ml|gsm|hp|kva|kw|w|a|v|ah|bar|ton|ply|nos?"


def normalize_item(c: Column) -> Column:
    """FN-18: lower case, sizes dropped, abbreviations expanded word by word, then those of several words."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"\b\d+(\.\d+)?\s*({SIZE_UNITS})\b", " ")
    names = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() if " " not in k for x in (k, v)])
    joined = F.array_join(F.transform(F.regexp_extract_all(s, F.lit("[a-z]+"), F.lit(0)), lambda w: F.coalesce(F.try_element_at(names, w), w)), " ")
    for phrase, expansion in ABBREVIATIONS.items():
        if " " in phrase:
            joined = F.replace(joined, F.lit(phrase), F.lit(expansion))
    return joined


def word_terms(df: DataFrame, key: str, text: str, stop_words: Sequence[str] = ()) -> DataFrame:
    """(key, term, tf): words of two characters or more without stop words, and pairs of those left side by side."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    words = F.filter(words, lambda w: ~w.isin(*stop_words))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    grams = F.when(F.size("w") > 1, F.concat("w", pairs)).otherwise(F.col("w"))
    return df.select(key, words.alias("w")).select(key, F.explode(grams).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def char_terms(df: DataFrame, key: str, text: str, low: int = 3, high: int = 5) -> DataFrame:
    """(key, term, tf): character n-grams inside words padded by a space on both sides."""
    word = df.select(key, F.explode(F.split(F.lower(F.col(text)), r"(?U)[\s\x1c-\x1f]+")).alias("w")).where("w <> ''").select(key, F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    # a lambda of two parameters would get the position as the second
    slices = lambda n: F.transform(F.sequence(F.lit(1), F.length("w") - n + 1), lambda i: F.substr("w", i, F.lit(n)))
    none = F.array().cast("array<string>")
    grams = [F.when(F.length("w") >= n, slices(n)).otherwise(F.array("w") if n == low else none) for n in range(low, high + 1)]
    return word.select(key, F.explode(F.concat(*grams)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def weights(terms: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """(1 + ln tf) times idf, scaled to length 1 per key."""
    w = terms.join(idf, "term").withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def inverse_frequency(terms: DataFrame, n_docs: int, min_df: int = 1) -> DataFrame:
    df = terms.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    return df.select("term", (F.ln((1.0 + n_docs) / (1.0 + F.col("df"))) + 1).alias("idf"))


def search(queries: DataFrame, corpus: DataFrame, k: int = 3, query_text: str = "text", doc_text: str = "text", query_key: str = "query_id", doc_key: str = "doc_id", chars: bool = False, stop_words: Sequence[str] | None = None) -> DataFrame:
    """DOM-20, TOP-4: the k documents with the largest cosine of each query, ties by document; cosines that agree to nine
    places are ties, as the order of a sum's terms may change the last ones.

    Documents are scored where they lie (``sparse_search``), and the best of each task ranked; with more terms or queries than tasks
    may hold, one equi-join on the term, summed before ranking, gives the same. Keys name one row each. With ``chars`` character n-grams stand beside words as a
    second block of the same weight; a text in which only one block has terms is scaled by that block alone.
    Documents that share no term with a query have the score 0 and no row. ``stop_words`` are left out of the word
    block; Spark's English list if not given.
    """
    stops = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
    scored = sparse_search.search(queries, corpus, k, query_text, doc_text, query_key, doc_key, chars, stops)
    if scored is None:
        scored = _joined(queries, corpus, query_text, doc_text, query_key, doc_key, chars, stops)
    best = W.partitionBy(query_key).orderBy(F.round("score", 9).desc(), doc_key)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _joined(queries: DataFrame, corpus: DataFrame, query_text: str, doc_text: str, query_key: str, doc_key: str, chars: bool, stops: Sequence[str]) -> DataFrame:
    """(query_key, doc_key, score) of all pairs that share a term, by a join."""
    n = corpus.count()
    parts, held = [], {query_key: [], doc_key: []}
    blocks = [(lambda *of: word_terms(*of, stops), 1)] + ([(char_terms, 2)] if chars else [])
    for terms, min_df in blocks:
        dt, qt = terms(corpus, doc_key, doc_text), terms(queries, query_key, query_text)
        idf = inverse_frequency(dt, n, min_df)
        q = weights(qt, query_key, idf).withColumnRenamed("w", "qw")
        raw = dt.join(idf, "term").withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
        # the norm needs all terms of a document, the sum only those of a query
        norm = raw.groupBy(doc_key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        part = raw.join(q, "term").groupBy(query_key, doc_key).agg(F.sum(F.col("w") * F.col("qw")).alias("s"))
        parts.append(part.join(norm, doc_key).select(query_key, doc_key, (F.col("s") / F.col("norm")).alias("s")))
        held[doc_key].append(norm.select(doc_key))
        held[query_key].append(q.select(query_key).distinct())
    scored = reduce(DataFrame.unionByName, parts).groupBy(query_key, doc_key).agg(F.sum("s").alias("score"))
    for key, found in held.items():
        counts = reduce(DataFrame.unionByName, found).groupBy(key).agg(F.count("*").alias("__blocks"))
        scored = scored.join(counts, key).select(query_key, doc_key, (F.col("score") / F.sqrt("__blocks")).alias("score"))
    return scored


def decide(answers: DataFrame, top: DataFrame, master: DataFrame) -> DataFrame:
    """DOM-28: the proposed code if the master knows it, else the best match. answers (query_id, proposed), top
    (query_id, code), master (code)."""
    known = master.select(F.col("code").alias("proposed"), F.lit(True).alias("known")).distinct()
    out = answers.join(known, "proposed", "left").join(top, "query_id", "left")
    return out.select("query_id", F.when(F.col("known"), F.col("proposed")).otherwise(F.col("code")).alias("code"), F.when(F.col("known"), "answer").otherwise("text").alias("source"))


def accuracy(results: DataFrame) -> DataFrame:
    """AGG-23: top-1, chapter (first two digits) and top-k hits of (query_id, rank, code, truth)."""
    hit = F.col("code") == F.col("truth")
    by = results.groupBy("query_id").agg(
        F.max((hit & (F.col("rank") == 1)).cast("int")).alias("a"), F.max(((F.substring("code", 1, 2) == F.substring("truth", 1, 2)) & (F.col("rank") == 1)).cast("int")).alias("b"), F.max(hit.cast("int")).alias("c")
    )
    return by.agg(F.avg("a").alias("top1"), F.avg("b").alias("chapter"), F.avg("c").alias("top_k"))
