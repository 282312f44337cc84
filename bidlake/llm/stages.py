"""Helpers by which operators rewrite or drop documents and keep all their columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, begin, fresh, give_back


def _bytes(column: pa.Array) -> list:
    return column.cast(pa.large_binary() if column.type == pa.large_string() else pa.binary()).to_pylist()


def rewrite_texts(docs: DataFrame, text_col: str, kernel: Callable[[], Callable]) -> DataFrame:
    """Rows whose text ``kernel()`` maps to bytes, with that text; rows mapped to None go.

    All other columns pass through the Arrow batch untouched and are never turned into
    Python objects, whatever their number, names and types.
    """
    schema = docs.schema
    at = [f.name for f in schema].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        fn = kernel()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                old = part.column(at)
                new = [fn(x) for x in _bytes(old)]
                columns = list(part.columns)
                columns[at] = pa.array(new, type=pa.binary()).cast(old.type)
                out = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield out.filter(pa.array([x is not None for x in new]))
        del fn
        give_back()

    return docs.mapInArrow(run, schema)


def edit_texts(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, edit: Callable) -> DataFrame:
    """``edit(text bytes, value)`` for the rows that ``found`` (id, key, value) names; None drops a row.

    ``key`` is the hash of the text (``common.keyed_bytes``); ids and keys together are unique in
    ``found``, so rows that repeat an id, with the same text or another, stay as many as they are. Other
    rows, and all other columns, pass as they are. The names used inside avoid those of ``docs``.
    """
    row_id, row_key, value = fresh(docs, "id", "key", "value")
    named = found.toDF(row_id, row_key, value)
    same = (docs[id_col].cast("long") == named[row_id]) & (F.xxhash64(docs[text_col].cast("binary")) == named[row_key])
    joined = docs.join(named, same, "left").drop(row_id, row_key)
    schema = docs.schema
    at = [f.name for f in schema].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                values = part.column(part.num_columns - 1)
                columns = list(part.columns)[:-1]
                names = part.schema.names[:-1]
                if values.null_count < len(values):
                    old, values = columns[at], values.to_pylist()
                    new = [t if v is None else edit(t or b"", v) for t, v in zip(_bytes(old), values, strict=True)]
                    columns[at] = pa.array(new, type=pa.binary()).cast(old.type)
                    keep = pa.array([v is None or n is not None for v, n in zip(values, new, strict=True)])
                    yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)
                else:
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    return joined.mapInArrow(run, schema)
