"""Substring dedup with fixed-block anchors.

Documents are dealt into chunks by their id; the text is shuffled once and
read three times.  (1) Every chunk indexes its reference blocks (``block``
words, not overlapping) and probes with every rolling window of ``block``
words: the distinct hashes of a chunk go to the index's parts, which answer
per hash whether a reference block has it and whether it occurs twice.  A
window of ``window`` words holds a whole reference block of its document when
``2 * block - 1 <= window``, so two equal windows always meet there.  (2) Hits
are extended while the neighbouring hashes repeat too; the windows inside such
a stretch, the only ones that can repeat, send a 96-bit key, once for each
chunk, from its first place; the key's part answers which places are not the
first of all.  (3) The words of these windows are removed.

A passage that stands in a third of all documents is one hash or key for each
chunk, so no part grows with it.  Rows of an id that has more text than a
chunk are made one row and a count where their texts are equal, and dealt by id
and text; their keys carry the place in the document, by which their parts find
the first place of an id that stands in several chunks.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spread import materialize
from .common import sha

WINDOW = 20
CHUNK_BYTES = 8 << 20  # text of a chunk
PART_ENTRIES = 2_000_000  # hashes of a part of the index
ROW_BYTES = 64  # what a row counts besides its text
REPEATS = 10_000  # equal rows that are written at once
NULL_ID = -(1 << 63)  # stands for a null id, before all others
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _rolling(h: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Hash of ``size`` neighbours from each place on (fewer places than ``h``)."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * base + h[i:n + i]
    return out


class Chunk:
    """The documents of a chunk in order of id, and then of text, as one sequence of words."""

    def __init__(self, table: pa.Table, window: int):
        ids = table.column("doc_id").to_pylist()
        data = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (NULL_ID if ids[i] is None else ids[i], data[i]))
        self.ids = [ids[i] for i in order]
        many = table.column("n").to_pylist() if "n" in table.column_names else [1] * len(ids)
        self.many = [many[i] for i in order]  # equal rows that a document stands for
        self.words = [data[i].split() for i in order]
        self.size = np.fromiter(map(len, self.words), np.int64, len(order))
        self.start = np.cumsum(self.size) - self.size
        self.n, self.window, self.block = int(self.size.sum()), window, (window + 1) // 2
        self.place = np.arange(self.n) - np.repeat(self.start, self.size)  # in its document
        self.left = np.repeat(self.size, self.size) - self.place  # words from here to the document's end

    def hashes(self) -> np.ndarray:
        h = xxhash.xxh64_intdigest
        return np.array([h(w) for d in self.words for w in d], np.uint64)

    def blocks(self, h: np.ndarray, parts: int):
        """Distinct block hashes in order of part: ``(part, low 32 bits, is a reference block, occurs twice,
        places, index of the hash at each place)``."""
        at = np.flatnonzero(self.left >= self.block)
        g = _mix(_rolling(h, self.block, _B1)[at])
        own, inverse, count = np.unique(g, return_inverse=True, return_counts=True)
        part = ((own >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        inverse = back[inverse]
        reference = np.zeros(len(own), bool)
        reference[inverse[self.place[at] % self.block == 0]] = True
        return part[order], own[order].astype(np.uint32), reference, (count > 1)[order], at, inverse


def _cuts(part: np.ndarray):
    edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    return list(zip(part[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(part)]))


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _flags(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(schema)], schema=schema)


_PROBE = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("low", pa.binary()), ("reference", pa.binary()), ("twice", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("anchor", pa.binary()), ("repeated", pa.binary())])
_KEYS = pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int64()), ("k1", pa.binary()), ("k2", pa.binary()),
                   ("at", pa.binary()), ("doc", pa.binary()), ("place", pa.binary())])
_REMOVED = pa.schema([("chunk", pa.int64()), ("kind", pa.int64()), ("at", pa.binary()), ("more", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'bigint'}" for f in schema)


def _answer_probes(table: pa.Table) -> pa.Table:
    """One part of the index: which hashes have a reference block and which occur twice, over all chunks."""
    low = [np.frombuffer(b, np.uint32) for b in table.column("low").to_pylist()]
    size = [len(x) for x in low]
    h = np.concatenate(low)
    reference = np.concatenate([_flags(b, n) for b, n in zip(table.column("reference").to_pylist(), size)])
    twice = np.concatenate([_flags(b, n) for b, n in zip(table.column("twice").to_pylist(), size)])
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    number = np.diff(np.append(first, len(s)))
    anchor, repeated = np.empty(len(h), bool), np.empty(len(h), bool)
    anchor[order] = np.repeat(np.logical_or.reduceat(reference[order], first), number)
    repeated[order] = np.repeat(np.logical_or.reduceat(twice[order], first) | (number > 1), number)
    anchor &= repeated
    cut = np.cumsum([0, *size])
    return _table(_ANSWER, [(c, p, _bits(anchor[a:b]), _bits(repeated[a:b])) for c, p, a, b in zip(
        table.column("chunk").to_pylist(), table.column("part").to_pylist(), cut[:-1], cut[1:])])


def _send_keys(chunk: Chunk, number: int, answers: pa.Table, parts: int, places: bool) -> pa.Table:
    """Keys of the windows inside extended hits, each from its first place; the other places are removed here.
    ``places``: an id may stand in several chunks, so that the place in the document is sent too."""
    h = chunk.hashes()
    part, low, _, _, at, inverse = chunk.blocks(h, parts)
    anchor, repeated = np.zeros(len(low), bool), np.zeros(len(low), bool)
    told = {p: (a, r) for p, a, r in zip(*(answers.column(c).to_pylist() for c in ("part", "anchor", "repeated")))}
    for p, a, b in _cuts(part):
        anchor[a:b], repeated[a:b] = (_flags(x, b - a) for x in told[p])
    here_a, here_r = np.zeros(chunk.n + 1, np.int64), np.zeros(chunk.n + 1, np.int64)
    here_a[at + 1], here_r[at + 1] = anchor[inverse], repeated[inverse]
    sum_a, sum_r = np.cumsum(here_a), np.cumsum(here_r)
    span = chunk.window - chunk.block + 1  # blocks of a window
    w = np.flatnonzero(chunk.left >= chunk.window)
    w = w[(sum_r[w + span] - sum_r[w] == span) & (sum_a[w + span] > sum_a[w])]
    k1 = _mix(_rolling(h, chunk.window, _B1)[w])
    k2 = _mix(_rolling(h, chunk.window, _B2)[w]).astype(np.uint32)
    ids = np.array([NULL_ID if i is None else i for i in chunk.ids], np.int64)
    rank = np.cumsum(np.append(0, ids[1:] != ids[:-1])) if len(ids) else ids
    owner = np.repeat(np.arange(len(chunk.size)), chunk.size)[w]
    when = rank[owner] << 32 | chunk.place[w] if len(w) else w
    order = np.lexsort((when, k2, k1))
    s1, s2 = k1[order], k2[order]
    first = np.append(True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])) if len(order) else np.zeros(0, bool)
    lead = order[np.flatnonzero(first)][np.cumsum(first) - 1] if len(order) else order
    same = when[order] == when[lead]  # the first place, or a row with the same id at the same place
    removed = np.zeros(chunk.n, bool)
    removed[w[order[~same]]] = True
    tied = np.stack([w[order[same & ~first]], w[lead[same & ~first]]]).astype(np.uint32)
    sent = np.sort(order[first])
    to = (k1[sent] >> np.uint64(20)) % np.uint64(parts)
    sent = sent[by := np.argsort(to, kind="stable")]
    rows = [(number % parts, number, 1, None, None, _bits(removed), tied.tobytes(), None)]
    for p, a, b in _cuts(to[by].astype(np.int64)):
        i = sent[a:b]
        rows.append((p, number, 0, k1[i].tobytes(), k2[i].tobytes(), w[i].astype(np.uint32).tobytes(), ids[owner[i]].tobytes(),
                     chunk.place[w[i]].astype(np.uint32).tobytes() if places else None))
    return _table(_KEYS, rows)


def _answer_keys(table: pa.Table) -> pa.Table:
    """One part of the keys: the places that are not the first; a chunk's own row passes through."""
    kind = table.column("kind").to_pylist()
    chunk = table.column("chunk").to_pylist()
    at, doc = table.column("at").to_pylist(), table.column("doc").to_pylist()
    rows = [(chunk[i], 1, at[i], doc[i]) for i, k in enumerate(kind) if k == 1]
    some = [i for i, k in enumerate(kind) if k == 0]
    if some:
        k1 = np.concatenate([np.frombuffer(b, np.uint64) for i in some for b in [table.column("k1")[i].as_py()]])
        k2 = np.concatenate([np.frombuffer(b, np.uint32) for i in some for b in [table.column("k2")[i].as_py()]])
        ids = [np.frombuffer(doc[i], np.int64) for i in some]
        d = np.concatenate(ids)
        place = [table.column("place")[i].as_py() for i in some]
        place = np.concatenate([np.zeros(len(x), np.uint32) if b is None else np.frombuffer(b, np.uint32) for b, x in zip(place, ids)])
        order = np.lexsort((place, d, k2, k1))
        s1, s2 = k1[order], k2[order]
        first = np.append(True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]))
        lead = order[np.flatnonzero(first)][np.cumsum(first) - 1]
        late = np.empty(len(order), bool)
        late[order] = (d[order] != d[lead]) | (place[order] != place[lead])  # rows of one id at the same place are no later
        end = 0
        for i, x in zip(some, ids):
            begin, end = end, end + len(x)
            gone = np.frombuffer(at[i], np.uint32)[late[begin:end]]
            if len(gone):
                rows.append((chunk[i], 0, gone.tobytes(), b""))
    return _table(_REMOVED, rows)


def deal(ids: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int, int, bool]:
    """``(rows dealt by chunk, chunks, bytes of text, whether an id may stand in several chunks)`` of
    ``ids(doc_id, text)``; if so, equal rows of such an id are one with their number ``n``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    sizes = ids.groupBy("doc_id").agg(F.sum(size).alias("bytes"), F.sum(size + F.lit(ROW_BYTES)).alias("weight"))
    total, most = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("weight"), F.lit(0))).first()
    chunks = max(1, -(-total // chunk_bytes))
    known = F.coalesce("doc_id", F.lit(NULL_ID))
    rows = ids.select(F.pmod(F.xxhash64(known), F.lit(chunks)).alias("chunk"), "doc_id", "text")
    if most > chunk_bytes:
        hot = materialize(sizes.where(F.col("weight") > chunk_bytes).select(F.col("doc_id").alias("hot_id")), "hot")
        same = F.col("doc_id").eqNullSafe(F.col("hot_id"))
        equal = ids.join(hot, same, "left_semi").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
        equal = equal.select(F.pmod(F.xxhash64(known, "text"), F.lit(chunks)).alias("chunk"), "doc_id", "text", "n")
        rows = rows.join(hot, same, "left_anti").withColumn("n", F.lit(1).cast("long")).unionByName(equal)
    return rows.repartition(chunks, "chunk"), chunks, total, most > chunk_bytes


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True,
                   chunk_bytes: int = CHUNK_BYTES, part_entries: int = PART_ENTRIES) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_sha256`` and, with ``keep_text``, ``kept`` (words joined by a space).

    Words are ``[^\\x20\\x09-\\x0D]+``.  A word is removed when a window of
    ``window`` words over it has a sequence that starts earlier (smaller id,
    or same id and earlier start).  ``id_col`` must be an integer; a null id
    is before all others.  Rows of one id count as one document: at the same
    start neither is earlier, so repeated rows keep what one row keeps.  Null
    and empty texts have no words; an empty table gives no rows.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt, chunks, total, shared = deal(ids, chunk_bytes)
    parts = max(1, -(-total // (6 * part_entries)))  # about a word for six bytes

    def probe(key, table):  # (these have no type hints: Spark would read them)
        part, low, reference, twice, _, _ = (c := Chunk(table, window)).blocks(c.hashes(), parts)
        return _table(_PROBE, [(p, key[0].as_py(), low[a:b].tobytes(), _bits(reference[a:b]), _bits(twice[a:b])) for p, a, b in _cuts(part)])

    def send(key, table, answers):
        return _send_keys(Chunk(table, window), key[0].as_py(), answers, parts, shared)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if keep_text else "")
    columns = StructType.fromDDL(out).names
    out += ", n bigint" if shared else ""
    out_arrow = to_arrow_schema(StructType.fromDDL(out))

    def finish(key, table, removed):
        c = Chunk(table, window)
        gone = np.zeros(c.n, bool)
        tied = np.zeros((2, 0), np.int64)
        for kind, at, more in zip(*(removed.column(x).to_pylist() for x in ("kind", "at", "more"))):
            if kind == 1:
                gone |= _flags(at, c.n)
                tied = np.frombuffer(more, np.uint32).reshape(2, -1)
            else:
                gone[np.frombuffer(at, np.uint32)] = True
        gone[tied[0]] |= gone[tied[1]]
        delta = np.zeros(c.n + 1, np.int64)
        begin = np.flatnonzero(gone)
        np.add.at(delta, begin, 1)
        np.add.at(delta, begin + window, -1)
        keep = np.cumsum(delta)[:-1] == 0
        rows = []
        for i, words, s, n in zip(c.ids, c.words, c.start.tolist(), c.many):
            mine = keep[s:s + len(words)]
            kept = b" ".join(words if mine.all() else compress(words, mine.tolist()))
            rows.append((i, len(words), int(len(words) - mine.sum()), sha(kept), *([kept.decode()] if keep_text else []), *([n] if shared else [])))
        return _table(out_arrow, rows)

    probes = dealt.groupBy("chunk").applyInArrow(probe, _ddl(_PROBE))
    answers = probes.repartition(parts, "part").groupBy("part").applyInArrow(lambda t: _answer_probes(t), _ddl(_ANSWER)).repartition(chunks, "chunk")
    keys = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(send, _ddl(_KEYS))
    removed = keys.repartition(parts, "part").groupBy("part").applyInArrow(lambda t: _answer_keys(t), _ddl(_REMOVED)).repartition(chunks, "chunk")
    done = dealt.groupBy("chunk").cogroup(removed.groupBy("chunk")).applyInArrow(finish, out)
    if not shared:
        return done
    # equal rows are written again, many of them by several tasks
    pieces = done.select(*columns, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(REPEATS))).alias("from")).repartition(chunks)
    return pieces.select(*columns, F.explode(F.sequence(F.col("from"), F.least("n", F.col("from") + REPEATS) - 1)).alias("i")).select(*columns)
