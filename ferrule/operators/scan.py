"""Ordered numbering and running totals inside groups that may be hot.

``row_number()``/running ``sum()`` over ``partitionBy(group)`` put a whole
group in one task.  When one key can hold a third of the rows that task is
the job.  ``grouped_scan`` instead

1. deals the rows into ranges of ``(group, order)`` (Spark's range
   partitioning, which samples the keys inside the cluster), so a hot group
   spans many ranges, and writes them once with the range's number: every
   later step reads the same ranges, also after an executor is lost;
2. numbers / sums inside each ``(range, group)``, bounded by the range;
3. aggregates one row per ``(range, group)`` and turns it into offsets with a
   window over that small table (at most ``ranges + groups`` rows);
4. joins the offsets back on the same keys as the window, without another
   shuffle of the rows.

The path is the same for every size; the number of ranges is the session's
shuffle partitions unless given.  The group key travels as a struct, which is
never null, so rows with a null in a group column form a group like any other.

``order`` must be ascending and a total order inside a group (end it with a
unique id); nulls come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_parts
from .spread import materialize


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def dealt_ranges(df: DataFrame, by: list[str], order: list[str | Column], slices: int | None = None) -> DataFrame:
    """``df`` with ``_g`` (group key), ``_o0..`` (order) and ``_slice`` (number of its range), stored."""
    order_c = _cols(order)
    base = df.withColumns({f"_o{i}": c for i, c in enumerate(order_c)})
    base = base.withColumn("_g", F.struct(*[F.col(b) for b in by]) if by else F.struct(F.lit(0)))
    keys = ["_g"] + [f"_o{i}" for i in range(len(order_c))]
    dealt = base.repartitionByRange(slices or shuffle_parts(df.sparkSession), *keys)
    return materialize(dealt.withColumn("_slice", F.spark_partition_id()), "ranges")


def grouped_scan(
    df: DataFrame,
    by: list[str],
    order: list[str | Column],
    number: str | None = "rn",
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add a 1-based ``number`` (bigint), inclusive running ``sums`` and
    running ``maxes`` per group.  Nulls are ignored by both; a running value
    is null only while the group had nothing but nulls."""
    sums = sums or {}
    maxes = maxes or {}
    values = {f"_v_{name}": expr for name, expr in {**sums, **maxes}.items()}
    n_order = len(order)
    base = dealt_ranges(df.withColumns(values) if values else df, by, order, slices)

    w_local = (
        Window.partitionBy("_slice", "_g")
        .orderBy(*[F.col(f"_o{i}") for i in range(n_order)])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    aggs = [F.count(F.lit(1)).alias("_cnt")] + [
        F.sum(f"_v_{name}").alias(f"_tot_{name}") for name in sums
    ] + [F.max(f"_v_{name}").alias(f"_tot_{name}") for name in maxes]
    totals = base.groupBy("_slice", "_g").agg(*aggs)  # partial aggregation, tiny output
    w_prev = Window.partitionBy("_g").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(
        "_slice",
        "_g",
        F.coalesce(F.sum("_cnt").over(w_prev), F.lit(0)).alias("_off_n"),
        *[F.sum(f"_tot_{name}").over(w_prev).alias(f"_off_{name}") for name in sums],
        *[F.max(f"_tot_{name}").over(w_prev).alias(f"_off_{name}") for name in maxes],
    )
    out = base.join(offs, on=["_slice", "_g"], how="inner")
    if number:
        out = out.withColumn(number, F.row_number().over(w_local) + F.col("_off_n"))
    for name in sums:
        local, off = F.sum(f"_v_{name}").over(w_local), F.col(f"_off_{name}")
        zero = F.lit(0).cast(base.schema[f"_v_{name}"].dataType)
        out = out.withColumn(name, F.when(local.isNotNull() | off.isNotNull(), F.coalesce(local, zero) + F.coalesce(off, zero)))
    for name in maxes:
        out = out.withColumn(name, F.greatest(F.max(f"_v_{name}").over(w_local), F.col(f"_off_{name}")))
    drop = ["_slice", "_g", "_off_n"] + [f"_o{i}" for i in range(n_order)] + [
        c for name in [*sums, *maxes] for c in (f"_v_{name}", f"_off_{name}")
    ]
    return out.drop(*drop)
