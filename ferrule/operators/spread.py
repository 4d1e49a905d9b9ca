"""Spread rows before heavy per-row work.

A table stored as one large file (or one parquet row group) is read by one
task, and so is everything up to the next shuffle: tokenising, regex over
whole texts, HTML rewrites.  ``spread`` round-robins such input over the
cluster's parallelism; when the scan is already split wider (the normal case
for a large table of many files) it does nothing, so it never adds a shuffle
at scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, parts: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Round-robin ``df`` over at least ``parts`` tasks when its scan gives
    fewer.

    Catalyst pushes deterministic filters through a repartition; a filter
    on an expensive expression would then run in the single scan task.  The
    usual source is the filter ``size(arr) > 0`` inferred for a non-outer
    ``explode``: after ``spread`` use ``explode_outer``/``posexplode_outer``
    and drop the null row instead.

    With ``by`` the rows are hash-partitioned on those columns instead, so a
    later aggregation grouped by a superset of them needs no other shuffle
    (e.g. tokens exploded from a document, grouped by document and bucket).
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df  # already dealt by a shuffle; counting its partitions would run it
    target = parts or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:  # of a scan: planning only, no job
        return df
    return df.repartition(target, *by) if by else df.repartition(target)


def materialize(df: DataFrame, name: str = "materialized") -> DataFrame:
    """Write ``df`` once as a Parquet table below the shared folder
    (``spark.checkpoint.dir``) and read it back: later uses (counts, joins)
    do not recompute it, and the lineage is cut so a lost executor does not
    replay the upstream work.  (An eager ``checkpoint()`` would compute the
    plan twice: once to count, once to write.)"""
    from ..session import scratch_path

    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)
