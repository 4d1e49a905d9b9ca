"""Exact cosine top-k that visits only the cells that can still matter.

The corpus is dealt to the nearest of ``pivots`` sampled vectors (a bounded
sample, the first by hash of the id).  The angle between unit vectors is a
metric, so with a row's angle to its pivot known, a query at angle ``d`` from
that pivot is at least ``max(0, d - high, low - d)`` away from every row
whose angle lies in ``[low, high]``.  Each pivot's rows are cut into rings of
about ``cell_rows`` rows by that angle; a cell is a ring of a pivot.

A query looks at its cells in order of that least angle, in rounds: first as
many cells as hold ``k`` rows, then a few more, then all others - and in each
round only those whose best possible score reaches the k-th score it has.
What is left out cannot be among the first k, so the result is exact, ties
included; how many cells the bounds leave out depends on how the vectors
cluster.

Cells of many rows (equal vectors have one angle, so no ring splits them)
and cells that many queries visit are split by salts on both sides.  The
driver and the executors' closures hold pivots and cell borders only, at
most ``pivots x (dim + 3 x RINGS)`` numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import materialize, spread
from .vectors import RANK_DIGITS, _cell_schema, _final_topk, _make_cell_topk, _prep

RINGS = 64  # of a pivot at most
ROUNDS = (0, 8)  # cells visited beside those that hold k rows, in all rounds but the last
SLACK = 2e-9  # scores are ranked on 9 digits


def unit(rows) -> np.ndarray:
    """Rows as unit vectors; NaN for a zero vector."""
    m = np.stack(rows).astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, m / n, np.nan)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def sample_vectors(rows: DataFrame, id_col: str, count: int) -> np.ndarray:
    """The non-zero vectors (as unit vectors) among the first ``count`` rows by hash of the id; ``count`` bounds what the driver holds."""
    some = rows.orderBy(F.xxhash64(id_col, F.lit(11)), id_col).limit(count).select("v").toPandas()["v"]
    if not len(some):
        return np.zeros((0, 0))
    m = unit(some.to_numpy())
    return m[np.isfinite(m).all(1)]


class Cells(NamedTuple):
    """Pivots and, per cell, its pivot, ring, rows and the angles between which they lie."""

    pivots: np.ndarray
    pivot: np.ndarray
    ring: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def order(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query: the cells by least possible angle (then distance of the pivot), and the best possible score of each."""
        d = angles(q, self.pivots)[:, self.pivot]
        least = np.maximum(0.0, np.maximum(d - self.high, self.low - d))
        at = np.lexsort((np.broadcast_to(np.arange(d.shape[1]), d.shape), d, least), axis=1)
        return at, np.cos(np.take_along_axis(least, at, 1))


class PivotIndex(NamedTuple):
    rows: DataFrame  # pivot, ring, id, v of every corpus row with a direction
    cells: Cells


def build(corpus: DataFrame, pivots: int = 256, cell_rows: int = 20000, id_col: str = "id", vec_col: str = "vector") -> PivotIndex:
    """Deal every corpus row to its cell; the table is stored in the shared folder.  Null and zero vectors have no cell."""
    c = _prep(corpus, id_col, vec_col, "id")
    p = sample_vectors(c, "id", pivots)

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if not len(df):
                continue
            m = unit(df["v"].to_numpy())
            ok = np.isfinite(m).all(1)
            df, d = df[ok], angles(m[ok], p)
            at = d.argmin(1) if len(df) else np.zeros(0, np.int64)
            yield pd.DataFrame({"pivot": at.astype(np.int32), "angle": d[np.arange(len(df)), at], "id": df["id"], "v": df["v"]})

    kind = c.schema["id"].dataType.simpleString()
    made = f"pivot int, angle double, id {kind}, v array<double>"
    dealt = spread(c.select("id", F.col("v").cast("array<double>").alias("v")))
    if not len(p):
        return PivotIndex(c.sparkSession.createDataFrame([], f"pivot int, ring int, id {kind}, v array<double>"), Cells(p, *[np.zeros(0)] * 5))
    dealt = materialize(dealt.mapInPandas(nearest, made), "dealt")
    shares = [i / RINGS for i in range(1, RINGS)]
    borders = dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("angle", shares, 10000).alias("b")).toPandas()
    step = np.ceil(borders["n"].to_numpy() / cell_rows).clip(1, RINGS)  # rings wanted
    lists = {int(k): np.unique(np.asarray(b)[[int(round(i * RINGS / s)) - 1 for i in range(1, int(s))]]) for k, b, s in zip(borders["pivot"], borders["b"], step)}

    def ringed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            ring = np.zeros(len(df), np.int32)
            for k, at in df.groupby("pivot").indices.items():
                ring[at] = np.searchsorted(lists[k], df["angle"].to_numpy()[at])
            yield df.assign(ring=ring)[["pivot", "ring", "angle", "id", "v"]]

    rows = materialize(dealt.mapInPandas(ringed, f"pivot int, ring int, angle double, id {kind}, v array<double>"), "cells")
    own = rows.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).toPandas().sort_values(["pivot", "ring"])
    return PivotIndex(rows.drop("angle"), Cells(p, *[own[x].to_numpy() for x in ("pivot", "ring", "n", "low", "high")]))


def _visits(queries: DataFrame, cells: Cells, k: int, before: int | None, extra: int | None, kind: str, least: float | None, spare: int) -> DataFrame:
    """``pivot, ring, qid, v``: the cells of one round.  ``queries`` (qid, v, kth) were in the rounds up to ``before`` extra cells."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for a in range(0, len(df), 512):
                some = df.iloc[a:a + 512]
                m = unit(some["v"].to_numpy())
                ok = np.isfinite(m).all(1)
                some, m = some[ok], m[ok]
                if not len(some):
                    continue
                at, best = cells.order(m)
                held = np.cumsum(cells.rows[at], 1)
                need = (held < k + spare).sum(1) + 1  # cells that hold k rows beside the query's own
                place = np.arange(at.shape[1])[None, :]
                first = np.zeros(len(some), int) if before is None else need + before
                last = at.shape[1] if extra is None else need + extra
                go = (place >= first[:, None]) & (place < np.broadcast_to(last, len(some))[:, None])
                kth = np.maximum(some["kth"].to_numpy(np.float64), -2.0 if least is None else least)
                go &= best + SLACK >= kth[:, None]
                r, c = np.nonzero(go)
                cell = at[r, c]
                yield pd.DataFrame({"pivot": cells.pivot[cell], "ring": cells.ring[cell], "qid": some["qid"].to_numpy()[r], "v": some["v"].to_numpy()[r]})

    return queries.mapInPandas(run, f"pivot int, ring int, qid {kind}, v array<double>")


def _salted(visits: DataFrame, rows: DataFrame, cells: Cells, asked: pd.DataFrame, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``q_salt, c_salt``: about ``cell_rows`` rows of each side a salted cell, each side copied to the other's salts."""
    n = pd.DataFrame({"pivot": cells.pivot, "ring": cells.ring, "rows": cells.rows}).merge(asked, on=["pivot", "ring"])
    n = n.assign(n_q=np.ceil(n["asked"] / cell_rows).astype(int), n_c=np.ceil(n["rows"] / cell_rows).astype(int))
    spark = visits.sparkSession
    salts = F.broadcast(spark.createDataFrame(n[["pivot", "ring", "n_q", "n_c"]].values.tolist(), "pivot int, ring int, n_q int, n_c int"))  # a row per cell
    own = lambda key, m: F.pmod(F.xxhash64(key), F.col(m)).cast("int")
    others = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    q = visits.join(salts, ["pivot", "ring"]).withColumn("q_salt", own("qid", "n_q")).withColumn("c_salt", others("n_c"))
    c = rows.join(salts, ["pivot", "ring"]).withColumn("c_salt", own("id", "n_c")).withColumn("q_salt", others("n_q"))
    return q, c


def search(index: PivotIndex, queries: DataFrame, k: int = 2, min_score: float | None = None, query_id: str = "qid", vec_col: str = "vector",
           exclude_self: bool = False, cell_rows: int = 20000) -> tuple[DataFrame, DataFrame]:
    """Exact top-k ``(qid, rank, id, score)`` of ``knn``, and ``(round, visits, pairs)``: cells visited and pairs scored.

    Same results as ``knn`` for every data set: score falling, ties by id, ``min_score`` inclusive, null and zero vectors never
    match.  Query ids must be distinct; a query id that occurs twice is one query."""
    spark = queries.sparkSession
    q = _prep(queries, query_id, vec_col, "qid").select("qid", F.col("v").cast("array<double>").alias("v"))
    kind, id_type = q.schema["qid"].dataType, index.rows.schema["id"].dataType
    schema = _cell_schema(kind, id_type)
    found = spark.createDataFrame([], schema)
    told = []
    if not len(index.cells.pivots):
        return _final_topk(found, k).select("qid", "rank", "id", "score"), spark.createDataFrame([], "round int, visits bigint, pairs bigint")
    q = materialize(spread(q.dropDuplicates(["qid"])), "queries")
    size = pd.DataFrame({"pivot": index.cells.pivot, "ring": index.cells.ring, "rows": index.cells.rows})
    asked = q.withColumn("kth", F.lit(-2.0))
    before = None
    for r, extra in enumerate((*ROUNDS, None)):
        v = materialize(_visits(asked, index.cells, k, before, extra, kind.simpleString(), min_score, int(exclude_self)), "visits")
        per = v.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("asked")).toPandas()  # a row per cell at most
        both = per.merge(size, on=["pivot", "ring"])
        told.append((r, int(per["asked"].sum()), int((both["asked"] * both["rows"]).sum())))
        if len(per):
            a, b = _salted(v, index.rows, index.cells, per, cell_rows)
            keys = ["pivot", "ring", "q_salt", "c_salt"]
            hits = a.select(*keys, "qid", "v").groupBy(*keys).cogroup(b.select(*keys, "id", "v").groupBy(*keys)).applyInPandas(
                _make_cell_topk(k, min_score, exclude_self), schema)
            found = materialize(_final_topk(found.unionByName(hits), k).select("qid", "id", "score"), "found")
        before = extra
        if extra is not None:  # the k-th score so far of the queries that have k
            kth = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min(F.round("score", RANK_DIGITS)).alias("low")).where(F.col("n") >= k)
            asked = q.join(kth, "qid", "left").select("qid", "v", F.coalesce("low", F.lit(-2.0)).alias("kth"))
    return _final_topk(found, k).select("qid", "rank", "id", "score"), spark.createDataFrame(told, "round int, visits bigint, pairs bigint")


def default_pivots(rows: int) -> int:
    """About the square root, between 16 and 1024."""
    return int(min(1024, max(16, math.sqrt(rows))))
