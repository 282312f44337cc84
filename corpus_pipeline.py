"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. quality rules: rejected documents go, failing lines of the others too
2. line dedup: later copies of repeated line runs of 50 words or more are deleted
3. n-gram Jaccard join: one document of each class stays (five words, 0.8 or more)
4. benchmark decontamination: contaminated documents go, rarer hits are cut from the others
5. SentencePiece encoding and decoding: one row of token counts and digests per document

A stage takes the session, its predecessor's documents and the folder of the tables; all but the
last return the columns of the documents.

Defined results: null and empty texts fail the quality rules and go; rows with a null id pass stages 2 to 4 as
they are (no copy of another is found in them, none is cut) and get a row in the last; rows that repeat an id and a text
share its fate; rows that repeat an id with another text are judged on their own but for stage 3, which takes an
id as one document; an empty table gives no rows; extra columns of any name pass through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from bidlake.llm import decontaminate, line_runs, ngram_join, piece_codec, quality_rules
from bidlake.llm.common import shared_folder
from bidlake.llm.queries import MODEL, table, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_runs.remove_runs(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.encode_digests(docs, vocabulary(MODEL))


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", encoding),
]

#: The stages hold rules, components and a tokenizer, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each keeps is written and read again in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _drop(spark, f"{folder}/{k - 1}")  # nothing reads it any more
    return docs


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
