"""Connected components of links between 64-bit nodes, by alternating star steps.

Each round is two grouped minima with joins on the same keys; the links are
written to the shared folder after each round, and the rounds end when a round
changes nothing (a number that grows with the logarithm of the links' depth).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spread import materialize


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())


def roots(links: DataFrame) -> DataFrame:
    """``links(u, v)`` -> ``(u, v)``: each node that has a smaller node in its component, and the smallest one."""
    now = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        last = now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        far = both.where("v > u").join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = far.groupBy("u").agg(F.min("v").alias("m"))
        near = far.join(low.select(F.col("u").alias("c"), "m"), F.col("u") == F.col("c")).where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(near.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, mark = mark, _mark(now)
        # the marks only tell rounds apart cheaply; of equally many distinct links, none is new exactly if nothing has changed
        if mark == before and now.join(last, ["u", "v"], "left_anti").isEmpty():
            break
    return now
