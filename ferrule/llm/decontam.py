"""Benchmark decontamination with suffix arrays over the training texts.

A shard is some megabytes of documents inside a task.  Its words are numbered
by the benchmark's vocabulary (other words and document ends are 0, where a
match cannot go on) and a suffix array is built over all numbered positions:
suffixes sorted by their words, several words packed in one integer, as deep
as a window.  Every benchmark suffix is binary-searched in every shard; the
range of suffixes that begin with its window are all the places where the
window occurs, and windows that follow each other on one diagonal make the
longest verbatim match.

The benchmark is sent to the tasks in blocks of a checked size; with several
blocks each document's spans of all blocks are united.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, id_text, keep_rows, map_batches, sha

WINDOW = 13  # words
SHARE = 20  # contaminated: hit words times this reach the document's words
BLOCK_BYTES = 16 << 20  # benchmark text sent to the tasks at once
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return data.translate(_KEEP).split()


@dataclass
class Windows:
    """Distinct windows of a block of items: word numbers (0 beyond a window's length), and their items."""

    vocabulary: dict[bytes, int]
    numbers: np.ndarray  # windows x width
    length: np.ndarray
    items: list[list[str]]  # ids of the items with each window
    first: np.ndarray  # of each window and one more: where its places begin
    rows: np.ndarray  # item row of each place
    positions: np.ndarray  # word position of each place

    @property
    def bits(self) -> int:
        return max(1, len(self.vocabulary).bit_length())


def windows_of(rows: list[tuple[str | None, bytes]], width: int = WINDOW) -> Windows:
    """Windows of ``(item id as text, text)`` rows; a shorter item is one window."""
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple, int] = {}
    items: list[set] = []
    places: list[list] = []
    for row, (item, text) in enumerate(rows):
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        for p in range(max(1, len(ids) - width + 1) if ids else 0):
            k = found.setdefault(tuple(ids[p:p + width]), len(found))
            if k == len(items):
                items.append(set())
                places.append([])
            if item is not None:
                items[k].add(item)
            places[k].append((row, p))
    numbers = np.zeros((len(found), width), np.uint64)
    for w, k in found.items():
        numbers[k, :len(w)] = w
    flat = np.array([x for p in places for x in p], np.int64).reshape(-1, 2)
    return Windows(vocabulary, numbers, np.array([len(w) for w in found], np.int64), [sorted(s) for s in items],
                   np.cumsum([0, *map(len, places)]), flat[:, 0], flat[:, 1])


class SuffixArray:
    """Positions of a number sequence sorted by the numbers from there on, ``width`` deep, each ending at a 0."""

    def __init__(self, numbers: np.ndarray, width: int, bits: int):
        n = len(numbers)
        self.per = 64 // bits
        self.bits = bits
        stop = np.append(np.flatnonzero(numbers == 0), n)
        at = np.flatnonzero(numbers)
        run = stop[np.searchsorted(stop, at)] - at
        padded = np.append(numbers, np.zeros(width + self.per, np.uint64)).astype(np.uint64)
        columns = []
        for c in range(-(-width // self.per)):
            key = np.zeros(len(at), np.uint64)
            for j in range(c * self.per, (c + 1) * self.per):
                key = (key << np.uint64(bits)) | (np.where(j < run, padded[np.minimum(at + j, n)], np.uint64(0)) if j < width else np.uint64(0))
            columns.append(key)
        order = np.argsort(columns[0], kind="stable")
        first = columns[0][order]
        same = np.append(False, first[1:] == first[:-1])
        tied = np.flatnonzero((same | np.append(same[1:], False)) & (run[order] > self.per))
        if len(tied) and len(columns) > 1:
            # the suffixes that go beyond the first column come last among equals, or in any order if masked alike
            group = np.flatnonzero(same | np.append(same[1:], False))
            some = order[group]
            order[group] = some[np.lexsort([c[some] for c in reversed(columns)])]
        self.at = at[order]
        self.columns = [c[order] for c in columns]

    def _bound(self, column: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
        """Binary search of each value in its own range of a column."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            there = column[np.minimum(mid, len(column) - 1)]
            low = (there <= value) if right else (there < value)
            lo = np.where(open_ & low, mid + 1, lo)
            hi = np.where(open_ & ~low, mid, hi)
        return lo

    def ranges(self, numbers: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with the first ``length`` numbers of each row."""
        q = len(numbers)
        lo, hi = np.zeros(q, np.int64), np.full(q, len(self.at))
        if not len(self.at):
            return lo, lo
        for c, column in enumerate(self.columns):
            value, free = np.zeros(q, np.uint64), np.zeros(q, np.uint64)
            for j in range(c * self.per, (c + 1) * self.per):
                value <<= np.uint64(self.bits)
                free <<= np.uint64(self.bits)
                if j < numbers.shape[1]:
                    value |= np.where(j < length, numbers[:, j], np.uint64(0))
                free |= np.where(j < length, np.uint64(0), np.uint64((1 << self.bits) - 1))
            use = np.flatnonzero((length > c * self.per) & (lo < hi))
            if not len(use):
                break
            a, b = lo[use], hi[use]
            if c == 0:
                lo[use] = np.searchsorted(column, value[use], "left")
                hi[use] = np.searchsorted(column, (value | free)[use], "right")
            else:
                lo[use] = self._bound(column, a, b, value[use], False)
                hi[use] = self._bound(column, a, b, (value | free)[use], True)
        return lo, np.maximum(lo, hi)


def pieces(doc: np.ndarray, weight: np.ndarray, limit: int):
    """Cuts of rows sorted by document, between documents, of about ``limit`` running weight each."""
    a, n = 0, len(doc)
    while a < n:
        b = int(np.searchsorted(weight, (weight[a - 1] if a else 0) + limit, "right"))
        b = min(n, max(b, a + 1))
        b = int(np.searchsorted(doc, doc[b - 1], "left")) if b < n and doc[b - 1] == doc[b] else b
        b = int(np.searchsorted(doc, doc[a], "right")) if b <= a else b
        yield a, b
        a = b


def search(texts: list[bytes], block: Windows) -> list[tuple[int, list[tuple[int, int]], list[int], int]]:
    """Of each text: words, hit spans (word positions, end exclusive), windows found, longest match in words."""
    parts = [words_of(t) for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    numbers = np.zeros(int(size.sum()) + len(parts), np.uint64)
    start = np.cumsum(size + 1) - size - 1
    get = block.vocabulary.get
    for s, p in zip(start.tolist(), parts):
        if p:
            numbers[s:s + len(p)] = np.fromiter(map(get, p, repeat(0)), np.uint64, len(p))
    array = SuffixArray(numbers, block.numbers.shape[1], block.bits)
    lo, hi = array.ranges(block.numbers, block.length)
    count = hi - lo
    window = np.repeat(np.arange(len(count)), count)
    place = array.at[np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)] if len(window) else window
    delta = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(delta, place, 1)
    np.add.at(delta, place + block.length[window], -1)
    hit = np.append(np.cumsum(delta)[:-1] > 0, False)
    edge = np.diff(np.append(False, hit).astype(np.int8))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    own = np.searchsorted(start, begins, "right") - 1
    doc = np.searchsorted(start, place, "right") - 1
    pair = np.unique(doc * max(1, len(count)) + window) if len(window) else np.zeros(0, np.int64)
    longest = np.zeros(len(parts), np.int64)
    np.maximum.at(longest, doc, block.length[window])
    many = block.first[window + 1] - block.first[window]  # places of each found window in the items
    order = np.argsort(doc, kind="stable")
    weight = np.cumsum(many[order])
    for a, b in pieces(doc[order], weight, 4_000_000):  # windows of one item on one diagonal, one after another
        o = order[a:b]
        k, m = window[o], many[o]
        at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(block.first[k], m)
        r, p = block.rows[at], block.positions[at]
        x, d, n = np.repeat(place[o], m), np.repeat(doc[o], m), np.repeat(block.length[k], m)
        order2 = np.lexsort((p, x - p, r))
        r, p, x, d, n = r[order2], p[order2], x[order2], d[order2], n[order2]
        new = np.append(True, (r[1:] != r[:-1]) | (x[1:] - p[1:] != x[:-1] - p[:-1]) | (p[1:] != p[:-1] + 1))
        first = np.flatnonzero(new)
        np.maximum.at(longest, d[first], n[first] + np.diff(np.append(first, len(r))) - 1)
    out = []
    cut = np.searchsorted(own, np.arange(len(parts) + 1))
    pcut = np.searchsorted(pair, np.arange(len(parts) + 1) * max(1, len(count)))
    for i, s in enumerate(start.tolist()):
        a, b = cut[i], cut[i + 1]
        out.append((int(size[i]), [(x - s, y - s) for x, y in zip(begins[a:b].tolist(), ends[a:b].tolist())],
                    (pair[pcut[i]:pcut[i + 1]] % max(1, len(count))).tolist(), int(longest[i])))
    return out


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_OUT = ("n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, longest_match bigint, "
        "items array<string>, spans array<struct<start:bigint,end:bigint>>")


def _told(n: int, spans: list, items: list[str], longest: int) -> tuple:
    hit = sum(e - s for s, e in spans)
    return n, hit, len(items), sha(",".join(items).encode()), hit > 0 and SHARE * hit >= n, longest, items, [{"start": s, "end": e} for s, e in spans]


def benchmark_blocks(items: DataFrame, width: int, block_bytes: int, item_col: str, item_text: str):
    """How many blocks the benchmark makes, and a function that broadcasts the windows of one of them."""
    bench = items.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    total = bench.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))

    def sent(b: int):
        part = bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else bench
        return items.sparkSession.sparkContext.broadcast(windows_of([(r.i, r.t.encode()) for r in part.distinct().collect()], width))

    return blocks, sent


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, items, spans``.

    ``spans`` are the hit word positions; ``longest_match`` the words of the
    longest verbatim match (0 without one).  Null and empty texts have no
    words; items without words have no window; an item without an id hits
    words but is not listed; repeated items count once, repeated documents
    give repeated results; ids may be null.  Empty benchmark: nothing is hit.
    """
    blocks, sent = benchmark_blocks(items, width, block_bytes, item_col, item_text)
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema[0].dataType.simpleString()

    def found(batch: pa.RecordBatch, block: Windows):
        data = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        for n, spans, windows, longest in search(data, block):
            yield n, spans, sorted({i for w in windows for i in block.items[w]}), longest

    if blocks == 1:
        only = sent(0)

        def run(batch: pa.RecordBatch) -> dict:
            got = [_told(*x) for x in found(batch, only.value)]
            names = [f.split()[0] for f in _OUT.split(", ")]
            return {"doc_id": batch.column(0)} | {k: [g[j] for g in got] for j, k in enumerate(names)}

        return map_batches(rows, run, f"doc_id {kind}, {_OUT}")

    each = None
    for b in range(blocks):
        block = sent(b)

        def some(batch: pa.RecordBatch, block=block) -> dict:
            got = list(found(batch, block.value))
            return {"doc_id": batch.column(0), "text_key": [sha(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()],
                    "n": [g[0] for g in got], "spans": [[{"start": s, "end": e} for s, e in g[1]] for g in got],
                    "items": [g[2] for g in got], "longest": [g[3] for g in got]}

        part = map_batches(rows, some, f"doc_id {kind}, text_key string, n bigint, spans array<struct<start:bigint,end:bigint>>, "
                                       "items array<string>, longest bigint").withColumn("copies", F.lit(1 if b == 0 else 0))
        each = part if each is None else each.unionByName(part)
    # one list for each block; rows of one id and text have one result, given as often as there are rows
    grouped = each.groupBy("doc_id", "text_key").agg(
        F.max("n").alias("n"), F.max("longest").alias("longest"), F.sum("copies").alias("copies"),
        F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def unite(batches):
        for batch in batches:
            got = [_told(n, united([(x["start"], x["end"]) for x in s]), sorted(i), m) for n, m, s, i in zip(
                *(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n", "longest", "spans", "items")))]
            names = [f.split()[0] for f in _OUT.split(", ")]
            types = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(),
                     "longest_match": pa.int64(), "items": pa.list_(pa.string()),
                     "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
            cols = [pa.array([g[j] for g in got], types[k]) for j, k in enumerate(names)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(batch.schema.get_field_index("copies")).cast(pa.int64()), *cols],
                                             ["doc_id", "copies", *names])

    return grouped.mapInArrow(unite, f"doc_id {kind}, copies bigint, {_OUT}").withColumn(
        "copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows of ``docs`` (all columns) that are not contaminated.  With a benchmark of one block that is one pass
    over the rows; else the spans of all blocks are united first and the rows are kept by id."""
    blocks, sent = benchmark_blocks(items, width, block_bytes, item_col, item_text)
    if blocks == 1:
        only = sent(0)

        def keep(batch: pa.RecordBatch) -> list[bool]:
            found = search([t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()], only.value)
            return [not _told(n, spans, [], 0)[4] for n, spans, _, _ in found]

        return filter_rows(docs, keep, text_col)
    told = contamination(docs, items, width, block_bytes, id_col, text_col, item_col, item_text)
    return keep_rows(docs, told.where(~F.col("contaminated")).select("doc_id"), id_col)
