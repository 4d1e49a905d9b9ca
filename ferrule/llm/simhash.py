"""SimHash near-dedup by ball hashing that meets in the middle.

Two fingerprints within the radius have a word in common among all words
within half the radius of each.  Every distinct fingerprint emits these
variants; variants are shuffled by their leading bits.  The variants of one
fingerprint have only a few different leading parts, so what travels is the
fingerprint, once for each such part, and its variants with that part are
written out where they are sorted and compared, in slices of bounded size.
Fingerprints that share a variant are verified by their bit distance; links
are reduced to one per fingerprint inside the task before the next shuffle.
Copies of a fingerprint are grouped first, so a large group of copies is one
fingerprint here.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spread import materialize
from ..session import shuffle_parts
from .common import id_text, map_batches
from .components import roots

SEED = 42  # fixed value: the shingle hash's seed
SLICE = 4_000_000  # variants compared at once
PER_BUCKET = 100_000  # fingerprints aimed at in a bucket
LEAST_BITS = 8


def fingerprint(data: bytes, shingle: int) -> int:
    """Bits set in over half of the shingles' hashes."""
    words = data.lower().split()  # A-Z only, and [\x20\x09-\x0D]
    if not words:
        return 0
    text, n, h = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return h(text, SEED)
    size = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    found = np.array([h(text[a:b], SEED) for a, b in zip(starts[:n - shingle + 1].tolist(), ends[shingle - 1:].tolist())], np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 15):
        part = found[i:i + (1 << 15)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return sum(1 << j for j in np.flatnonzero(2 * total > len(found)).tolist())


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, fp`` (signed)."""

    def run(batch: pa.RecordBatch) -> dict:
        got = [fingerprint(t or b"", shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        return {"doc_id": batch.column(0), "fp": np.array(got, np.uint64).view(np.int64)}

    rows = id_text(docs, id_col, text_col)
    return map_batches(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, fp bigint")


def masks(bits: int, most: int) -> np.ndarray:
    """All words of ``bits`` bits with at most ``most`` ones, few ones first."""
    return np.array([sum(1 << j for j in c) for k in range(most + 1) for c in combinations(range(bits), k)], np.uint64)


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the links ``a``-``b`` among ``n`` nodes."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        np.minimum.at(new, low[a], m)
        np.minimum.at(new, low[b], m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def shared(fps: np.ndarray, prefix: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of verified pairs that share a variant with the leading ``bits`` bits ``prefix``; of the
    fingerprints of one variant, each is paired with the first."""
    half, free = (radius + 1) // 2, 64 - bits
    none = np.zeros(0, np.int64)
    head = np.bitwise_count((fps >> np.uint64(free)) ^ np.uint64(prefix)) if bits else np.zeros(len(fps), np.uint8)
    low = fps & np.uint64((1 << free) - 1)
    left = [np.flatnonzero(head == d) for d in range(half + 1)]
    each = [masks(free, half - d) for d in range(half + 1)]
    size = sum(len(i) * len(m) for i, m in zip(left, each))
    if sum(map(len, left)) < 2:
        return none, none
    if size > SLICE and bits < 48:  # one bit more: two halves
        got = [shared(fps[k := np.flatnonzero(head <= half)], prefix << 1 | x, bits + 1, radius) for x in (0, 1)]
        return k[np.concatenate([g[0] for g in got])], k[np.concatenate([g[1] for g in got])]
    variants = np.concatenate([(low[i][:, None] ^ m[None, :]).ravel() for i, m in zip(left, each)])
    ordered = np.sort(variants)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return none, none
    mixed = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)
    seen = np.zeros(1 << 22, bool)
    seen[mixed(twice)] = True
    owners = np.concatenate([np.repeat(i, len(m)) for i, m in zip(left, each)])
    at = np.flatnonzero(seen[mixed(variants)])
    variants, owners = variants[at], owners[at]
    order = np.lexsort((owners, variants))
    variants, owners = variants[order], owners[order]
    first = np.append(True, variants[1:] != variants[:-1])
    run = np.cumsum(first) - 1
    a, b = owners[np.flatnonzero(first)][run][~first], owners[~first]
    pair = np.unique(a * len(fps) + b)
    a, b = pair // len(fps), pair % len(fps)
    fits = np.bitwise_count(fps[a] ^ fps[b]) <= radius
    return a[fits], b[fits]


def close_links(fps: DataFrame, radius: int = 4, n: int | None = None) -> DataFrame:
    """``(u, v)`` of distinct fingerprints (column ``fp``), enough links that everything reachable within
    ``radius`` bits stays reachable.  ``n``: how many there are (counted if not given)."""
    spark = fps.sparkSession
    n = fps.count() if n is None else n
    half, bits = (radius + 1) // 2, LEAST_BITS
    while bits < 40 and n * len(masks(bits, half)) / 2**bits > PER_BUCKET:
        bits += 1
    parts = F.array(*[F.lit(int(m)) for m in masks(bits, half)])
    head = F.shiftrightunsigned("fp", 64 - bits)
    sent = fps.select("fp", F.explode(F.transform(parts, lambda m: m.bitwiseXOR(head))).alias("bucket"))
    dealt = sent.repartition(max(shuffle_parts(spark), min(2**bits, n // PER_BUCKET)), "bucket").sortWithinPartitions("bucket")

    def links(bucket: int, found: list[np.ndarray]) -> pa.RecordBatch:
        own = np.unique(np.concatenate(found))
        a, b = shared(own, bucket, bits, radius)
        low = labels(len(own), a, b)
        at = np.flatnonzero(low != np.arange(len(own)))
        return pa.RecordBatch.from_arrays([pa.array(own[at].view(np.int64)), pa.array(own[low[at]].view(np.int64))], ["u", "v"])

    def run(batches):
        now, found = None, []
        for batch in batches:
            bucket = batch.column(1).to_numpy(zero_copy_only=False)
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
            for s, e in zip(edges, [*edges[1:], len(bucket)]):
                if bucket[s] != now:
                    if found:
                        yield links(int(now), found)
                    now, found = bucket[s], []
                found.append(fp[s:e])
        if found:
            yield links(int(now), found)

    return dealt.mapInArrow(run, "u bigint, v bigint")


def near_groups(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable.

    Null and empty texts have fingerprint zero and are linked like any other;
    a text of fewer words than a shingle is one shingle.  Repeated rows and
    rows with one fingerprint are in one component; null ids do not count as
    smallest unless a component has no other.  An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    own = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    star = roots(close_links(own.select("fp"), radius, own.count()))
    member = own.join(star, F.col("fp") == F.col("u"), "left").select("fp", "low", F.coalesce("v", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("low").alias("component_id"))
    known = member.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
