"""Secrets in texts: fixed patterns, and two character Markov models compared by log-likelihood ratio.

The patterns give the base spans.  The models add spans: one is trained on
random strings (values that the patterns found in a bounded sample of
documents, and strings drawn from a seeded generator over the usual
alphabets), the other on ordinary identifiers (words of the same documents
outside base spans).  A candidate is a run of identifier characters; its
score is the mean log-likelihood ratio per character.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_batches, sha, texts

# fixed values: the patterns of the contract, group 2 of `assign` being the value, and the least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run of 18 or more
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "markov")  # order among spans of one start

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")  # the least length of an assigned value
WORD = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"  # fixed value: the candidates' characters
_CODE = np.full(128, -1, np.int64)
_CODE[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))
N = len(SYMBOLS) + 1  # and a state for the start

SAMPLE_DOCS = 4000  # documents of the training sample, the first by hash of the id
PLAIN_DIGITS = 2  # an ordinary identifier has no more digits
THRESHOLD = 2.0  # mean log-likelihood ratio of a character, in nats


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, sorted; offsets in code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def spans_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def pair_counts(words: list[str]) -> np.ndarray:
    """How often each character follows each other one (row ``N - 1``: the start)."""
    out = np.zeros((N, N))
    if words:
        codes, first = _codes(words)
        before = np.append(N - 1, codes[:-1])
        before[first] = N - 1
        np.add.at(out, (before, codes), 1)
    return out


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = _CODE[np.frombuffer("".join(words).encode(), np.uint8)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    return codes, np.cumsum(size) - size


def drawn_strings(count: int = 2000, seed: int = 17) -> list[str]:
    """Labelled random strings over the usual alphabets of keys."""
    r = random.Random(seed)
    alphabets = [SYMBOLS[:62], SYMBOLS[:64], SYMBOLS[:62] + "_-", SYMBOLS[:26] + SYMBOLS[52:62], SYMBOLS[26:62]]
    return ["".join(r.choices(r.choice(alphabets), k=r.randint(ASSIGN_LEAST, 48))) for _ in range(count)]


def log_ratio(random_counts: np.ndarray, plain_counts: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """Log-likelihood ratio of each step, both models smoothed towards their character frequencies."""

    def model(c):
        unigram = (c.sum(0) + smooth) / (c.sum() + smooth * N)
        return (c + 20 * smooth * unigram) / (c.sum(1, keepdims=True) + 20 * smooth)

    return np.log(model(random_counts)) - np.log(model(plain_counts))


def scores(ratio: np.ndarray, words: list[str]) -> np.ndarray:
    """Mean log-likelihood ratio per character of each word."""
    codes, first = _codes(words)
    before = np.append(N - 1, codes[:-1])
    before[first] = N - 1
    size = np.diff(np.append(first, len(codes)))
    return np.add.reduceat(ratio[before, codes], first) / size


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """The step ratios, from ``sample_docs`` documents at most (the first by hash of the id; a documented
    bound).  Only counts of ``N x N`` numbers a batch reach the driver."""
    rows = id_text(docs, "doc_id", "text")
    at = F.xxhash64(F.col("doc_id"))
    edge = rows.select(at.alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    if edge is None:
        return log_ratio(pair_counts(drawn_strings()), pair_counts([]))

    def run(batch: pa.RecordBatch) -> dict:
        good, plain = [], []
        for t in texts(batch):
            spans = base_spans(t)
            good += [v for s, k, e in spans for v in WORD.findall(t[s:e])[-1:] if len(v) >= ASSIGN_LEAST]
            clear = list(t)
            for s, _, e in spans:
                clear[s:e] = " " * (e - s)
            plain += [w for w in WORD.findall("".join(clear)) if sum(map(str.isdigit, w)) <= PLAIN_DIGITS]
        return {"good": [pair_counts(good).ravel().tolist()], "plain": [pair_counts(plain).ravel().tolist()]}

    sums = map_batches(rows.where(at <= F.lit(edge)), run, "good array<double>, plain array<double>")
    each = sums.select(F.posexplode(F.arrays_zip("good", "plain")).alias("at", "n"))
    total = each.groupBy("at").agg(F.sum("n.good").alias("good"), F.sum("n.plain").alias("plain")).toPandas()
    good, plain = np.zeros(N * N), np.zeros(N * N)
    good[total["at"]], plain[total["at"]] = total["good"], total["plain"]
    return log_ratio(good.reshape(N, N) + pair_counts(drawn_strings()), plain.reshape(N, N))


def find_secrets(docs: DataFrame, ratio: np.ndarray | None = None, threshold: float = THRESHOLD,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, n_markov, base`` and ``spans`` (``kind:start:end`` by start,
    then kind; code points, end exclusive) and ``base_sha256``.

    A candidate run becomes a ``markov`` span when the mean ratio of the whole
    run passes ``threshold`` and no base span covers it entirely; base spans may
    lie inside it.  Null and empty texts have no spans;
    repeated rows give repeated results; ids may be null.  One pass without a
    shuffle; ``ratio`` is a table of fixed size.
    """
    ratio = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))) if ratio is None else ratio

    def run(batch: pa.RecordBatch) -> dict:
        ts = texts(batch)
        base = [base_spans(t) for t in ts]
        where, words = [], []
        for i, t in enumerate(ts):
            k, reach, own = 0, 0, base[i]
            for m in CANDIDATE.finditer(t):  # both in order of their starts: one walk
                s, e = m.span()
                while k < len(own) and own[k][0] <= s:
                    reach = max(reach, own[k][2])
                    k += 1
                if reach < e:
                    where.append((i, s, e))
                    words.append(m[0])
        spans = [list(b) for b in base]
        if words:
            for j in np.flatnonzero(scores(ratio, words) > threshold):
                i, s, e = where[j]
                spans[i].append((s, 3, e))
        told = [spans_text(b) for b in base]
        count = lambda k: [sum(x[1] == k for x in s) for s in spans]
        return {"doc_id": batch.column(0), "n_assign": count(0), "n_access": count(1), "n_hex": count(2), "n_markov": count(3),
                "base": told, "base_sha256": [sha(b.encode()) for b in told], "spans": [spans_text(sorted(s)) for s in spans]}

    rows = id_text(docs, id_col, text_col)
    return map_batches(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, "
                                  "n_markov bigint, base string, base_sha256 string, spans string")
