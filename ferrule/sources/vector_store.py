"""A vector collection as a table: points (id, vector, payload columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.embed import with_vector
from ..functions.text import embed_input, md5_uuid

COLLECTION = "knowledge"  # default collection name (a deployment parameter)


def upsert_vectors(state: DataFrame, batch: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """Last write per id wins across the current state and a new batch."""
    u = state.unionByName(batch)
    cols = [c for c in u.columns if c != key]
    return u.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*seq)).alias("_l")).select(key, "_l.*")


def delete_points(state: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Hard delete by id list."""
    return state.join(ids.select(key).distinct(), key, "left_anti")


def to_points(changes: DataFrame, key: str, text: str, collection: str = COLLECTION, dim: int = 384) -> DataFrame:
    """Change rows (op, key, text) -> points (collection_name, id, title,
    description, embed_text, vector).  A delete keeps its point with blank
    title/description (soft delete) and the embedding of ''."""
    d = F.col("op") == "d"
    p = changes.select(
        F.lit(collection).alias("collection_name"),
        md5_uuid(F.col(key)).alias("id"),
        F.when(d, F.lit("")).otherwise(F.col(key).cast("string")).alias("title"),
        F.when(d, F.lit("")).otherwise(F.col(text)).alias("description"),
        F.when(d, F.lit("")).otherwise(embed_input(F.col(key), F.col(text))).alias("embed_text"),
    )
    return with_vector(p, "embed_text", dim)  # deletes embed '': no vector
