"""Exact dedup by content-defined chunk recipes.

A normalised text (white space deleted) is cut where a rolling hash of 16
bytes has its top bits zero, so equal passages are cut alike wherever they
stand.  A chunk's identifier is its 128-bit hash; it is *verified*: the chunk
bytes meet once per identifier (after dropping repeats inside each task), and
if two different chunks had one identifier, all are made again with another
seed.  Two texts are equal when their ordered identifier lists are; only these
lists, 16 bytes for about a kilobyte of text, are grouped and joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spread import materialize
from .common import id_text, map_batches, sha, slices

SPACE = b" \t\n\r\x0b\x0c"  # fixed value: the deleted characters
WINDOW = 16
LEAST, MOST, CUT_BITS = 256, 8192, 10  # chunk sizes in bytes; a cut at one place in 2**CUT_BITS
_TABLE = np.random.default_rng(5).integers(1, 1 << 32, 256, dtype=np.uint32)


def cut_places(data: bytes) -> list[int]:
    """Ends of the windows at which a text may be cut, ascending."""
    if len(data) < WINDOW:
        return []
    h, step = _TABLE[np.frombuffer(data, np.uint8)], 1
    factor = 0x9E3779B1
    while step < WINDOW:  # hash of twice the width from two neighbours
        h = h[:-step] * np.uint32(factor) + h[step:]
        factor = factor * factor & 0xFFFFFFFF
        step *= 2
    return (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + WINDOW).tolist()


def chunks(texts: list[bytes]) -> list[list[bytes]]:
    """Chunks of each text.  A cut needs a whole window inside the chunk, so it depends on the text alone."""
    data = b"".join(texts)
    places = cut_places(data)
    places.append(len(data) + MOST)
    out, k, start = [], 0, 0
    for t in texts:
        end, parts = start + len(t), []
        while end - start > LEAST:
            while places[k] < start + LEAST:
                k += 1
            cut = min(places[k], start + MOST, end)
            parts.append(data[start:cut])
            start = cut
        if start < end:
            parts.append(data[start:end])
        start = end
        out.append(parts)
    return out


def normalised(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or b"").translate(None, SPACE) for t in batch.column(1).cast(pa.binary()).to_pylist()]


def identifier(chunk: bytes, seed: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk, seed)


def chunk_store(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The deduplicated chunks: ``id, bytes, other``; ``other`` differs from ``bytes`` if an identifier
    stands for more than one chunk.  Repeats inside a batch are dropped before the shuffle."""

    def run(batch: pa.RecordBatch) -> dict:
        seen = {identifier(c, seed) + c: c for parts in chunks(normalised(batch)) for c in parts}
        return {"id": [k[:16] for k in seen], "chunk": list(seen.values())}

    found = map_batches(id_text(docs, id_col, text_col).select("doc_id", "text"), run, "id binary, chunk binary")
    return found.groupBy("id").agg(F.min("chunk").alias("bytes"), F.max("chunk").alias("other"))


def recipes(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_chars, text_sha256`` and ``recipe``, the identifiers in order (16 bytes each)."""

    def run(batch: pa.RecordBatch) -> dict:
        norm = normalised(batch)
        return {"doc_id": batch.column(0), "n_chars": [len(t or "") for t in batch.column(1).to_pylist()],
                "text_sha256": [sha(t) for t in norm],
                "recipe": [b"".join(identifier(c, seed) for c in parts) for parts in chunks(norm)]}

    rows = id_text(docs, id_col, text_col)
    return map_batches(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_chars bigint, text_sha256 string, recipe binary")


def verified_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``recipes`` with a seed under which every identifier stands for one chunk, stored in the shared folder."""
    seed = 0
    while not chunk_store(docs, seed, id_col, text_col).where(F.col("bytes") != F.col("other")).isEmpty():
        seed += 1
    return materialize(recipes(docs, seed, id_col, text_col), "recipes")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, keep_id, group_size, kept, text_sha256, n_chunks``.

    Texts are equal when identical without ``[\\x20\\x09-\\x0D]``; null counts
    as empty, and all empty texts are equal.  Of equal texts the row with the
    most code points stays, then the smallest id (a null id comes first).
    ``group_size`` counts rows; rows that share an id share its result, so
    repeated rows are kept or dropped together.  An empty table gives no rows.
    A large group is summed inside the tasks before its list is shuffled, and
    the join back carries no text.
    """
    rows = verified_recipes(docs, id_col, text_col)
    groups = rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"),
                                        F.min(F.struct(-F.col("n_chars"), F.col("doc_id").alias("id"))).alias("best"))
    # stored, so that both sides of the join are plain shuffles, of which Spark splits a hot list's partition
    groups = materialize(groups.select("recipe", "group_size", F.col("best.id").alias("keep_id")), "groups")
    return rows.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
        F.floor(F.length("recipe") / 16).alias("n_chunks"))
