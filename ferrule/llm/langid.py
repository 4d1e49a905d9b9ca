"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character n-grams (1 to 3) of the lower-cased text; the
document frequencies come from all labelled rows.  The weights are learned by
follow-the-regularised-leader with elastic-net penalties on a bounded sample,
and a temperature is fitted on a second one.  Prediction reads whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import filter_rows, id_text, map_batches, texts

BITS = 16  # log2 of the number of features
ORDERS = 3
PIECE = 1 << 20  # characters whose n-grams are sorted at once
SLICE = 2 << 20  # bytes of text whose features are held at once
FIT_ROWS, TUNE_ROWS = 3000, 1000  # bounds of the samples that the weights and the temperature are fitted on
FIT_BYTES = 64 << 20  # bound of the characters of both samples
LANGUAGES = 400  # languages learned, the most frequent ones
UNKNOWN = "und"
_MULT = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def hashes(codes: np.ndarray) -> list[np.ndarray]:
    """Of each order: the feature of the n-gram that starts at each place."""
    out, h = [], np.zeros(len(codes), np.uint32)
    for k in range(min(ORDERS, len(codes))):
        m = len(codes) - k
        h = (h[:m] ^ (codes[k:] + np.uint32(k + 1))) * _MULT[k]
        h ^= h >> np.uint32(15)
        out.append((h * _MULT[(k + 1) % 3]) >> np.uint32(32 - BITS))
    return out


def long_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """``(feature, count)`` of one text of any length, in pieces that overlap by the longest n-gram."""
    total = np.zeros(1 << BITS, np.int64)
    for a in range(0, len(text), PIECE):
        codes = np.frombuffer(text[a:a + PIECE + ORDERS - 1].encode("utf-32-le"), np.uint32)
        for h in hashes(codes):
            total += np.bincount(h[:PIECE], minlength=1 << BITS)
    feats = np.flatnonzero(total)
    return feats, total[feats]


def features(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, feature, count)`` of the n-grams of each text, sorted; n-grams do not cross texts."""
    low = [x.lower() for x in batch]
    rows, feats, counts = [], [], []
    a = 0
    while a < len(low):  # runs of texts of about a piece together, and longer texts alone
        b, n = a, 0
        while b < len(low) and (b == a or n + len(low[b]) <= PIECE) and b - a < 1 << 32 - BITS:
            n += len(low[b])
            b += 1
        if n > PIECE:
            f, c = long_features(low[a])
            rows.append(np.full(len(f), a))
        else:
            codes = np.frombuffer("".join(low[a:b]).encode("utf-32-le"), np.uint32)
            own = np.repeat(np.arange(b - a, dtype=np.uint32), [len(x) for x in low[a:b]]) << np.uint32(BITS)
            keys = [(own[:len(h)] | h)[own[:len(h)] == own[k:]] for k, h in enumerate(hashes(codes))]
            key, c = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.uint32),) * 2
            rows.append((key >> np.uint32(BITS)).astype(np.int64) + a)
            f = (key & np.uint32((1 << BITS) - 1)).astype(np.int64)
        feats.append(f)
        counts.append(c.astype(np.int64))
        a = b
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(rows), np.concatenate(feats), np.concatenate(counts)


def corpus_counts(labelled: DataFrame) -> tuple[np.ndarray, int, dict[str, int]]:
    """In how many of the rows each feature occurs, how many rows there are, and of each language; one pass, summed inside the tasks first."""

    def run(batch: pa.RecordBatch) -> dict:
        _, f, _ = features(texts(batch, "text"))
        seen, n = np.unique(f, return_counts=True)
        langs = batch.column(1).value_counts()
        return {"f": [*seen.tolist(), *[-1] * len(langs)], "lang": [None] * len(seen) + langs.field(0).to_pylist(), "n": [*n.tolist(), *langs.field(1).to_pylist()]}

    got = map_batches(labelled.select("text", "lang"), run, "f bigint, lang string, n bigint", limit=SLICE).groupBy("f", "lang").agg(F.sum("n").alias("n"))
    df, langs = np.zeros(1 << BITS), {}
    for f, lang, n in got.toPandas().itertuples(index=False):
        if f < 0:
            langs[lang] = int(n)
        else:
            df[f] = n
    return df, sum(langs.values()), langs


@dataclass
class Model:
    """Weights (features x languages), bias, idf and temperature; of fixed size for a set of languages."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def values(self, r: np.ndarray, f: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
        """Unit-length TF-IDF values (logarithmic counts)."""
        x = (1 + np.log(c)) * self.idf[f]
        norm = np.sqrt(np.bincount(r, x * x, minlength=n))
        return x / np.maximum(norm, 1e-12)[r]

    def logits(self, r, f, c, n: int) -> np.ndarray:
        x = self.values(r, f, c, n)
        return np.stack([np.bincount(r, x * self.weights[f, k], minlength=n) for k in range(len(self.languages))], 1) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, passes: int = 3, alpha: float = 4.0,
             beta: float = 1.0, l1: float = 0.002, l2: float = 0.001, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader (per-coordinate rates, L1 and L2) over ``(features, values)`` rows."""
    size = (1 << BITS) + 1  # the last is the bias, without penalty
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    pen1, pen2 = np.full((size, 1), l1), np.full((size, 1), l2)
    pen1[-1] = pen2[-1] = 0

    def weights(i):
        zi = z[i]
        return -np.sign(zi) * np.maximum(np.abs(zi) - pen1[i], 0) / ((beta + np.sqrt(n[i])) / alpha + pen2[i])

    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for j in rng.permutation(len(rows)):
            f, x = rows[j]
            i, v = np.append(f, size - 1), np.append(x, 1.0)[:, None]
            w = weights(i)
            s = (w * v).sum(0)
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[j]] -= 1
            g = v * p
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weights(np.arange(size))
    return w[:-1], w[-1]


def fit_temperature(model: Model, logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, on a grid."""
    best, at = np.inf, 1.0
    for t in np.geomspace(0.05, 20, 60):
        model.temperature = float(t)
        p = model.probabilities(logits)[np.arange(len(y)), y]
        loss = -np.log(np.maximum(p, 1e-12)).mean()
        if loss < best:
            best, at = loss, float(t)
    return at


def sample(rows: DataFrame, langs: int, fit_rows: int, tune_rows: int, fit_bytes: int) -> DataFrame:
    """Of each language the distinct (id, text) rows that come first by hash, ``h, lang, text``: at most its share of the rows
    and, but for one row, of the characters."""
    per, size = (fit_rows + tune_rows) // langs + 1, fit_bytes // langs
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    order = Window.partitionBy("lang").orderBy("h")
    first = rows.select("lang", "h", F.length("text").cast("long").alias("n")).groupBy("lang", "h").agg(F.max("n").alias("n"))
    first = first.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per)
    first = first.withColumn("so_far", F.sum("n").over(order)).where((F.col("k") == 1) | (F.col("so_far") <= size))
    own = F.broadcast(first.select("lang", "h"))  # at most fit_rows + tune_rows + a row of each language
    return rows.join(own, ["lang", "h"]).groupBy("lang", "h").agg(F.max("text").alias("text"))


def train(labelled: DataFrame, fit_rows: int = FIT_ROWS, tune_rows: int = TUNE_ROWS, languages: int = LANGUAGES, fit_bytes: int = FIT_BYTES) -> Model | None:
    """A model from ``labelled(doc_id, text, lang)``; rows without text or language are left out.

    Document frequencies come from all rows.  Three bounds keep the fit on the driver: the weights come from ``fit_rows`` and
    the temperature from ``tune_rows`` rows at most, both together from ``fit_bytes`` characters, and at most ``languages``
    languages are learned, the most frequent ones (each costs 2 MB of weights on the driver and in a worker).  Rows are picked by
    hash of id and text within each language, repeated rows once, rows with a null id like any other; only their features
    reach the driver.  The table is read three times whatever the languages.  Without any row to fit on there is no model.
    """
    rows = labelled.where("text is not null and lang is not null and trim(text) <> ''")
    df, total, counts = corpus_counts(rows)
    langs = sorted(sorted(counts, key=lambda x: (-counts[x], x))[:languages])
    if not langs:
        return None
    idf = np.log((1 + total) / (1 + df)) + 1
    picked = sample(rows.where(F.col("lang").isin(langs)) if len(counts) > languages else rows, len(langs), fit_rows, tune_rows, fit_bytes)

    def run(batch: pa.RecordBatch) -> dict:
        r, f, c = features(texts(batch, "text"))
        at = np.searchsorted(r, np.arange(batch.num_rows + 1))
        cut = list(zip(at[:-1], at[1:]))
        return {"h": batch.column(0), "lang": batch.column(1), "f": [f[a:b].astype(np.int32).tobytes() for a, b in cut],
                "c": [c[a:b].astype(np.int32).tobytes() for a, b in cut]}

    got = map_batches(picked.select("h", "lang", "text"), run, "h bigint, lang string, f binary, c binary", limit=SLICE).toPandas()
    got = got.sort_values(["h", "lang"], ignore_index=True)
    number = {x: k for k, x in enumerate(langs)}
    y = got["lang"].map(number).to_numpy()
    model = Model(langs, np.zeros((1 << BITS, len(langs))), np.zeros(len(langs)), idf)
    data = []
    for f, c in zip(got["f"], got["c"]):
        f, c = (np.frombuffer(b, np.int32).astype(np.int64) for b in (f, c))
        data.append((f, model.values(np.zeros(len(f), np.int64), f, c, 1)))
    tune = np.arange(len(y)) % 4 == 3 if len(y) >= 40 else np.zeros(len(y), bool)
    fit = np.flatnonzero(~tune)
    model.weights, model.bias = fit_ftrl([data[j] for j in fit], y[fit], len(langs))
    if tune.any():
        logits = np.array([x @ model.weights[f] + model.bias for f, x in (data[j] for j in np.flatnonzero(tune))])
        model.temperature = fit_temperature(model, logits, y[tune])
    return model


def in_fold(id_col: str = "doc_id") -> Column:
    """Whether a row is held out: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def judge(ts: list[str], model: Model | None) -> tuple[list[str], list[float]]:
    """Language and calibrated probability of each text; ``und`` and 0 without a letter or a model."""
    lang, score = [UNKNOWN] * len(ts), [0.0] * len(ts)
    known = [i for i, t in enumerate(ts) if any(map(str.isalpha, t))]
    if model is not None and known:
        r, f, c = features([ts[i] for i in known])
        p = model.probabilities(model.logits(r, f, c, len(known)))
        for i, k, v in zip(known, p.argmax(1).tolist(), p.max(1).tolist()):
            lang[i], score[i] = model.languages[k], min(1.0, v)
    return lang, score


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, lang_pred, score``.

    ``score`` is the calibrated probability of the language.  A null text or
    one without a letter is ``und`` with score 0, as is everything without a
    model.  Repeated rows give repeated results; ids may be null.  One pass
    without a shuffle; the model has a fixed size.
    """

    def run(batch: pa.RecordBatch) -> dict:
        lang, score = judge(texts(batch), model)
        return {"doc_id": batch.column(0), "lang_pred": lang, "score": score}

    rows = id_text(docs, id_col, text_col)
    return map_batches(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, lang_pred string, score double", limit=SLICE)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows outside the held-out fold and predict all rows; adds ``held_out``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = train(rows.where(~in_fold()))
    return predict(rows, model).select("doc_id", in_fold().alias("held_out"), "lang_pred", "score")


def least_score(languages: int, lead: float = 1.2) -> float:
    """The least probability that counts as known: ``lead`` times chance among the learned languages, 1 at most."""
    return min(1.0, lead / max(languages, 1))


def keep_identified(docs: DataFrame, lead: float = 1.2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (all columns) whose language is known with a probability of ``least_score`` or more; one pass, no shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = train(rows.where(~in_fold()))
    least = least_score(len(model.languages) if model else 0, lead)

    def keep(batch: pa.RecordBatch) -> list[bool]:
        return [x != UNKNOWN and v >= least for x, v in zip(*judge(texts(batch), model))]

    return filter_rows(docs, keep, text_col, SLICE)
