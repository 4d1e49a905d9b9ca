"""Vector expressions (JVM side, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in double; a zero norm gives null (never retrieved)."""
    a = as_double(a)
    b = as_double(b)
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column | str) -> Column:
    """L2-normalised copy (null when the norm is zero)."""
    a = as_double(a)
    n = F.nullif(norm(a), F.lit(0.0))
    return F.when(n.isNull(), F.lit(None)).otherwise(F.transform(a, lambda x: x / n))
