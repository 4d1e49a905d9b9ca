"""Exact search by pivots and angle bounds equals the search over all pairs, and scores far fewer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.operators import pivots as P
from ferrule.operators.vectors import knn
from tests.conftest import rows

KW = dict(id_col="id", vec_col="vector")


def frame(spark, ids, m):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m)], "id long, vector array<double>")


def clustered(n, groups=40, dim=12, spread=0.05, seed=1):
    r = np.random.default_rng(seed)
    centre = r.standard_normal((groups, dim))
    return centre[r.integers(0, groups, n)] + spread * r.standard_normal((n, dim))


def asked(df):
    return df.where("id % 50 = 0").withColumnRenamed("id", "qid")


@pytest.mark.parametrize("cell_rows, k, least, own", [(20000, 2, None, True), (60, 5, 0.3, False), (25, 3, 0.99, True)])
def test_equals_search_over_all_pairs(spark, cell_rows, k, least, own):
    m = clustered(1500)
    m[100:160] = m[100]  # equal vectors: ties, and a cell that no ring splits
    m[7] = 0
    c = frame(spark, range(1500), m)
    q = asked(c)
    got, told = P.search(P.build(c, 32, cell_rows, **KW), q, k, least, exclude_self=own, cell_rows=cell_rows)
    want = knn(q, c, k=k, min_score=least, exclude_self=own)
    assert rows(got, ["qid", "rank", "id"]) == rows(want, ["qid", "rank", "id"])
    pairs = told.agg(F.sum("pairs")).first()[0]
    assert pairs < 0.25 * 30 * 1500


def test_vectors_without_clusters_are_still_exact(spark):
    m = np.random.default_rng(3).standard_normal((600, 16))
    c = frame(spark, range(600), m)
    got, _ = P.search(P.build(c, 20, 50, **KW), asked(c), 4, exclude_self=True)
    assert rows(got, ["qid", "rank", "id"]) == rows(knn(asked(c), c, k=4, exclude_self=True), ["qid", "rank", "id"])


def test_hot_cells_are_split_on_both_sides(spark):
    c = frame(spark, range(400), np.ones((400, 3)))
    index = P.build(c, 4, 50, **KW)
    assert len(index.cells.rows) == 1  # one angle: no ring
    v = c.select(F.lit(int(index.cells.pivot[0])).alias("pivot"), F.lit(0).alias("ring"), F.col("id").alias("qid"), F.col("vector").alias("v"))
    per = v.groupBy("pivot", "ring").agg(F.count("*").alias("asked")).toPandas()
    a, b = P._salted(v, index.rows, index.cells, per, 50)
    n = {tuple(r[:2]): r[2] for r in a.groupBy("q_salt", "c_salt").count().collect()}
    m = {tuple(r[:2]): r[2] for r in b.groupBy("q_salt", "c_salt").count().collect()}
    assert len(n) == 64 and set(n) == set(m) and max(n.values()) < 100 and max(m.values()) < 100
    assert sum(x * m[s] for s, x in n.items()) == 400 * 400
    got, _ = P.search(index, asked(c), 3, exclude_self=True, cell_rows=50)
    assert rows(got, ["qid", "id"]) == rows(knn(asked(c), c, k=3, exclude_self=True), ["qid", "id"])


def test_edges(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    c = frame(spark, [1, 2, 3], [[0, 0], [1, 0], [1, 1]]).unionByName(spark.createDataFrame([(4, None)], none.schema))
    q = spark.createDataFrame([(9, [1.0, 0.2]), (10, [0.0, 0.0]), (11, None)], "qid long, vector array<double>")
    got, _ = P.search(P.build(c, **KW), q, 5)
    assert rows(got, ["qid", "rank", "id"]) == [(9, 1, 2), (9, 2, 3)]  # fewer than k is fine
    assert P.search(P.build(none, **KW), q)[0].count() == 0
    assert P.search(P.build(c, **KW), none.withColumnRenamed("id", "qid"))[0].count() == 0
