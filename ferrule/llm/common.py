"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20  # text handled at once inside a task


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of ``column`` (one row at least)."""
    n = batch.num_rows
    col = batch.column(batch.schema.get_field_index(column))
    if n <= 1 or col.nbytes <= limit:
        if n:
            yield batch
        return
    half = n // 2
    yield from slices(batch.slice(0, half), column, limit)
    yield from slices(batch.slice(half), column, limit)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, column: str = "text",
                limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` with bounded pieces: ``fn(batch) -> {column: list or array}`` for the columns of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)

    def run(batches):
        target = to_arrow_schema(out)
        for batch in batches:
            for piece in slices(batch, column, limit):
                got = fn(piece)
                arrays = [x.cast(f.type) if isinstance(x := got[f.name], pa.Array) else pa.array(x, type=f.type) for f in target]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, out)


def filter_rows(df: DataFrame, keep: Callable[[pa.RecordBatch], list[bool]], text_col: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """Rows for which ``keep(batch)`` is true, in one pass; ``batch`` has the text alone, the rows keep all columns."""
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, batch.schema.names[at], limit):
                text = pa.RecordBatch.from_arrays([piece.column(at)], ["text"])
                got = piece.filter(pa.array(keep(text), pa.bool_()))
                if got.num_rows:
                    yield got

    return df.mapInArrow(run, df.schema)


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, as ``doc_id`` and ``text``: other columns, whatever their names, stay out."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def keep_rows(docs: DataFrame, keep: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is in ``keep`` (null matches null); columns unchanged."""
    name = "_keep_id"
    while name in docs.columns:
        name += "_"
    k = keep.select(F.col(keep.columns[0]).alias(name))
    return docs.join(k, F.col(id_col).eqNullSafe(F.col(name)), "left_semi")
