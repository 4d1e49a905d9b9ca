"""The trained index: codes and estimates against plain numpy, recall against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.operators import pq_index as Q
from ferrule.operators.vectors import knn, recall
from tests.conftest import rows
from tests.test_pivots import asked, clustered, frame


def test_estimates_are_the_scores_of_the_decoded_rows():
    m = clustered(400, dim=8)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    centres = Q.kmeans(m, 6, 1, normal=True)
    books = np.random.default_rng(2).standard_normal((4, Q.WORDS, 2))
    model = Q.Model(centres, books)
    cell, code = Q.encode(model, m)
    for i in range(20):
        assert cell[i] == np.argmin(np.linalg.norm(centres - m[i], axis=1))
        left = (m[i] - centres[cell[i]]).reshape(4, 2)
        assert code[i].tolist() == [int(np.argmin(np.linalg.norm(books[p] - left[p], axis=1))) for p in range(4)]
    decoded = centres[cell] + np.stack([books[p][code[:, p]] for p in range(4)], 1).reshape(len(m), -1)
    at = np.flatnonzero(cell == cell[0])
    assert np.allclose(Q.estimates(model, m[:5], int(cell[0]), code[at]), m[:5] @ decoded[at].T)


@pytest.mark.parametrize("cell_rows", [20000, 40])
def test_recall_on_clusters(spark, cell_rows):
    c = frame(spark, range(2000), clustered(2000, groups=60, dim=16, spread=0.3))
    model = Q.train(c, cells=16, parts=8)
    codes = Q.build(model, c)
    assert codes.count() == 2000
    got = Q.search(model, codes, c, asked(c), k=3, probes=4, rerank=40, exclude_self=True, cell_rows=cell_rows)
    r = recall(got, knn(asked(c), c, k=3, exclude_self=True))
    assert r.count() == 40 and r.agg(F.avg("recall")).first()[0] >= 0.9


def test_all_probes_and_all_rows_scored_is_exact(spark):
    c = frame(spark, range(300), clustered(300, dim=8))
    model = Q.train(c, cells=8, parts=4)
    got = Q.search(model, Q.build(model, c), c, asked(c), k=4, probes=8, rerank=300, min_score=0.2, exclude_self=True)
    want = knn(asked(c), c, k=4, min_score=0.2, exclude_self=True)
    assert rows(got, ["qid", "rank", "id"]) == rows(want, ["qid", "rank", "id"])


def test_edges(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    assert Q.train(none, parts=1) is None
    c = frame(spark, [1, 2, 3], [[0, 0], [1, 0], [1, 1]]).unionByName(spark.createDataFrame([(4, None)], none.schema))
    model = Q.train(c, cells=5, parts=2)
    q = spark.createDataFrame([(9, [1.0, 0.2]), (10, [0.0, 0.0]), (11, None)], "qid long, vector array<double>")
    assert rows(Q.search(model, Q.build(model, c), c, q, k=5), ["qid", "rank", "id"]) == [(9, 1, 2), (9, 2, 3)]
    with pytest.raises(ValueError):
        Q.train(frame(spark, [1], [[1, 2, 3]]), parts=2)
