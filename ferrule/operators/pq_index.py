"""Approximate cosine top-k by a trained index: coarse cells and product-quantised residuals.

``train`` fits a coarse quantiser (spherical k-means) and, on what is left of
a vector beside its cell's centre, one codebook for each of ``parts`` slices
of the dimensions.  Both are fitted on a sample of at most ``sample_rows``
rows, the first by hash of the id (a documented bound); the model holds
``cells x dim + parts x WORDS x dim / parts`` numbers at every size.

``build`` stores ``cell, id, code`` (a byte a part) for every row with a
direction.  ``search`` sends a query to its ``probes`` nearest cells, where a
row's score is estimated from the codes alone - the query's product with the
centre plus one table look-up a part - and scores the ``rerank`` best
estimates of each query exactly, with the vectors joined in by id.  Cells of
many rows or many queries are split by salts on both sides; only ``rerank``
estimates a query and cell leave a task.

``knn`` and ``pivots.search`` stay the exact ways.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pivots import sample_vectors, unit
from .spread import materialize, spread
from .vectors import FLOAT_ERROR, _final_topk, _prep

WORDS = 256  # codewords of a part: a byte
SAMPLE_ROWS = 20_000
PASSES = 12  # of k-means


class Model(NamedTuple):
    centres: np.ndarray  # cells x dim, unit vectors
    books: np.ndarray  # parts x WORDS x (dim / parts)

    @property
    def parts(self) -> int:
        return self.books.shape[0]


def _nearest(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (m @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)


def kmeans(m: np.ndarray, count: int, seed: int, passes: int = PASSES, normal: bool = False) -> np.ndarray:
    """Centres of the rows; starts at distinct rows, an empty centre stays where it was."""
    rng = np.random.default_rng(seed)
    start = np.unique(m, axis=0)
    c = start[np.sort(rng.choice(len(start), min(count, len(start)), replace=False))].copy()
    for _ in range(passes):
        at = _nearest(m, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, m)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if normal:
            length = np.linalg.norm(c, axis=1, keepdims=True)
            c = np.where(length > 1e-9, c / np.maximum(length, 1e-9), c)
    return c


def encode(model: Model, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and codes (a byte a part) of unit vectors."""
    cell = _nearest(m, model.centres)
    left = (m - model.centres[cell]).reshape(len(m), model.parts, -1)
    code = np.stack([_nearest(left[:, p], model.books[p]) for p in range(model.parts)], 1).astype(np.uint8)
    return cell, code


def estimates(model: Model, q: np.ndarray, cell: int, code: np.ndarray) -> np.ndarray:
    """Estimated score of each query with each coded row of a cell."""
    table = np.einsum("qpd,pwd->qpw", q.reshape(len(q), model.parts, -1), model.books)
    score = np.repeat((q @ model.centres[cell])[:, None], len(code), 1)
    for p in range(model.parts):
        score += table[:, p][:, code[:, p]]
    return score


def train(corpus: DataFrame, cells: int = 32, parts: int = 16, sample_rows: int = SAMPLE_ROWS, id_col: str = "id", vec_col: str = "vector",
          seed: int = 5) -> Model | None:
    """The model from a bounded sample; the dimension must be a multiple of ``parts``.  None without a vector that has a direction."""
    m = sample_vectors(_prep(corpus, id_col, vec_col, "id"), "id", sample_rows)
    if not len(m):
        return None
    if m.shape[1] % parts:
        raise ValueError(f"{m.shape[1]} dimensions do not split into {parts} parts")
    centres = kmeans(m, cells, seed, normal=True)
    left = (m - centres[_nearest(m, centres)]).reshape(len(m), parts, -1)
    books = np.zeros((parts, WORDS, left.shape[2]))
    for p in range(parts):
        got = kmeans(left[:, p], WORDS, seed + 1 + p)
        books[p, :len(got)] = got
        books[p, len(got):] = got[0]
    return Model(centres, books)


def build(model: Model, corpus: DataFrame, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """``cell, id, code`` of every row with a direction, stored in the shared folder."""
    c = _prep(corpus, id_col, vec_col, "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if not len(df):
                continue
            m = unit(df["v"].to_numpy())
            ok = np.isfinite(m).all(1)
            if not ok.any():
                continue
            cell, code = encode(model, m[ok])
            yield pd.DataFrame({"cell": cell.astype(np.int32), "id": df["id"][ok], "code": [x.tobytes() for x in code]})

    return materialize(spread(c).mapInPandas(run, f"cell int, id {c.schema['id'].dataType.simpleString()}, code binary"), "codes")


def search(model: Model, codes: DataFrame, corpus: DataFrame, queries: DataFrame, k: int = 2, probes: int = 8, rerank: int = 50,
           min_score: float | None = None, query_id: str = "qid", id_col: str = "id", vec_col: str = "vector", exclude_self: bool = False,
           cell_rows: int = 20000) -> DataFrame:
    """Approximate top-k ``(qid, rank, id, score)``; the scores are exact, ``rerank`` rows a query at most are scored."""
    q = _prep(queries, query_id, vec_col, "qid").dropDuplicates(["qid"])
    kind, id_type = (x.dataType.simpleString() for x in (q.schema["qid"], codes.schema["id"]))
    probes = min(probes, len(model.centres))

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if not len(df):
                continue
            m = unit(df["v"].to_numpy())
            ok = np.isfinite(m).all(1)
            df, m = df[ok], m[ok]
            if not len(df):
                continue
            at = np.argsort(-(m @ model.centres.T), axis=1, kind="stable")[:, :probes]
            for j in range(probes):
                yield pd.DataFrame({"cell": at[:, j].astype(np.int32), "qid": df["qid"], "v": list(m)})

    visits = spread(q).mapInPandas(near, f"cell int, qid {kind}, v array<double>")
    visits = materialize(visits, "visits")
    count = lambda df, name: df.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(cell_rows))).cast("int").alias(name))
    salts = F.broadcast(count(visits, "n_q").join(count(codes, "n_c"), "cell"))  # a row per cell
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = visits.join(salts, "cell").withColumn("q_salt", own("qid", "n_q")).withColumn("c_salt", others("n_c"))
    b = codes.join(salts, "cell").withColumn("c_salt", own("id", "n_c")).withColumn("q_salt", others("n_q"))

    def guess(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(qs) and len(cs):
            code = np.frombuffer(b"".join(cs["code"]), np.uint8).reshape(len(cs), -1)
            ids, qids = cs["id"].to_numpy(), qs["qid"].to_numpy()
            for at in range(0, len(qs), 256):
                s = estimates(model, np.stack(qs["v"].to_numpy()[at:at + 256]), int(cs["cell"].iloc[0]), code)
                if exclude_self:
                    s[qids[at:at + 256, None] == ids[None, :]] = -np.inf
                best = np.argpartition(-s, min(rerank, s.shape[1]) - 1, axis=1)[:, :rerank]
                for i, row in enumerate(best):
                    row = row[np.isfinite(s[i, row])]
                    out.append(pd.DataFrame({"qid": qids[at + i], "id": ids[row], "guess": s[i, row]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": qs["qid"].iloc[:0], "id": cs["id"].iloc[:0], "guess": np.zeros(0)})

    keys = ["cell", "q_salt", "c_salt"]
    some = a.select(*keys, "qid", "v").groupBy(*keys).cogroup(b.select(*keys, "id", "code").groupBy(*keys)).applyInPandas(
        guess, f"qid {kind}, id {id_type}, guess double")
    first = Window.partitionBy("qid").orderBy(F.desc("guess"), "id")
    chosen = some.withColumn("n", F.row_number().over(first)).where(F.col("n") <= rerank).select("qid", "id")
    vectors = _prep(corpus, id_col, vec_col, "id").select("id", F.col("v").alias("c"))
    pairs = chosen.join(vectors, "id").join(q.select("qid", "v"), "qid")

    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(np.einsum("nd,nd->n", unit(x.to_numpy()), unit(y.to_numpy())) if len(x) else np.zeros(0))

    scored = pairs.select("qid", "id", cosine("v", "c").alias("score"))
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score - FLOAT_ERROR)
    return _final_topk(scored, k).select("qid", "rank", "id", "score")
