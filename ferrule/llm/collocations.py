"""Phrase collocation mining over a prefix-free parse of the corpus.

Texts are split into pieces at ``.,;:!?`` and line breaks, and pieces into
words.  A word starts a new chunk where the hash of the three words from it
on is a multiple of ``EVERY``: the cut depends on the content alone, so a
passage that many documents share gives the same chunks everywhere.  Every
chunk also holds the ``LONGEST - 1`` words after it, so the chunks of a piece
overlap and no phrase of up to ``LONGEST`` words is lost between two of them;
``own`` says how many of a chunk's words are its own, and a phrase counts in
the chunk that owns its first word, so once.

The distinct chunks of a language are the dictionary, with the number of times
the parse uses them.  Phrases are counted inside the dictionary, weighted by
those numbers, in passes of two, three and four words (single words are counted
while parsing).  A phrase can only be frequent if its two shorter parts are, so
a pass skips what a Bloom filter over the frequent shorter phrases does not
hold.  The filter is sized by their number, at most ``MOST_BITS``; beyond that
it lets more through, and the counts stay exact.

Counts move as (language, phrase) with partial sums before every shuffle, so
a language with most rows, or a passage in a third of all documents, is no
hot group.  Long texts are parsed in segments of about ``SEGMENT`` bytes; a
piece that is cut there goes on in the next chunk, again by ``own``.

Defined cases: a null or empty text has no words; a null language is
``und``; ids play no part; repeated rows count every time; without a frequent
phrase there are no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.spread import materialize, spread
from .common import slices

LONGEST = 4  # words of a phrase
EVERY = 16  # words a chunk owns on average
SEGMENT = 1 << 20  # bytes of a text parsed at once
GATHER = 8 << 20  # bytes of chunks counted at once
MOST_BITS = 1 << 28  # of a Bloom filter: 32 MB
PROBES = 3
BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(BREAKS + b"\t", b"\n" * len(BREAKS) + b" ")
_STOP = re.compile(rb"[\n ]")
_AFTER = re.compile(rb"(?: +[^ \n]+){0,%d}" % (LONGEST - 1))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _encode(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Code of each word (bytes ``begins`` to ``ends`` of ``data``, in order), and the distinct words."""
    size = ends - begins
    inside = np.zeros(len(data) + 1, np.int8)
    inside[begins] += 1
    inside[ends] -= 1  # words are never empty and have a byte between them
    words = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    offsets = np.append(0, np.cumsum(size)).astype(np.int64)
    got = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(words)]).dictionary_encode()
    return got.indices.to_numpy(zero_copy_only=False).astype(np.int64), got.dictionary.to_pylist()


def segments(text: bytes) -> Iterator[tuple[bytes, int]]:
    """Parts of a text in lower case (of A-Z) with line feeds for breaks and spaces for tabs, each with the number of words at
    its end that belong to the next part."""
    text, at = text.lower().translate(_TABLE), 0
    while len(text) - at > SEGMENT and (stop := _STOP.search(text, at + SEGMENT)):
        end = _AFTER.match(text, stop.start()).end()
        yield text[at:end], len(text[stop.start():end].split())
        at = stop.start()
    yield text[at:], 0


class Parse(NamedTuple):
    """Chunks of some texts: the text each comes from, its words joined by one space, how many it owns; and each word's text and
    code among the distinct words."""

    of: list[int]
    chunks: list[bytes]
    own: list[int]
    word_of: np.ndarray
    codes: np.ndarray
    distinct: list[bytes]


def parse(texts: list[bytes]) -> Parse:
    parts = [(n, *x) for n, t in enumerate(texts) for x in segments(t)]
    text = b"\n".join([x[1] for x in parts] + [b""])  # parts end like pieces
    data = np.frombuffer(text, np.uint8)
    line = data == 10
    edge = np.diff((~(line | (data == 32))).astype(np.int8), prepend=0)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begins):
        return Parse([], [], [], begins, begins, [])
    codes, distinct = _encode(data, begins, ends)
    h = _word_hashes(distinct)[codes]
    lines = np.cumsum(line)[begins]
    first = np.flatnonzero(np.append(True, lines[1:] != lines[:-1]))  # words that begin pieces
    last = np.append(first[1:], len(h))
    piece = np.repeat(np.arange(len(first)), last - first)
    until = np.cumsum([len(x[1]) + 1 for x in parts])
    of = np.array([x[0] for x in parts])[np.searchsorted(until, begins[first], "right")]
    owned = last.copy()
    for n, (_, _, ahead) in enumerate(parts):
        if ahead:  # the last words of a part that go on in the next one
            owned[piece[np.searchsorted(begins, until[n]) - 1]] -= ahead
    three = np.zeros(len(h), np.uint64)
    if len(h) > 2:
        three[:-2] = h[:-2] * _A + h[1:-1] * _B + h[2:]
    place = np.arange(len(h))
    start = ((three >> np.uint64(32)) % np.uint64(EVERY) == 0) & (place + LONGEST - 1 <= last[piece]) & (place < owned[piece])
    start[first[first < owned]] = True
    starts = np.flatnonzero(start)
    at = piece[starts]
    body = np.minimum(np.append(starts[1:], len(h)), owned[at])
    stop = np.minimum(body + LONGEST - 1, last[at])
    lo, hi = begins[starts], ends[stop - 1]
    chunks = [text[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
    gaps = np.append(0, np.cumsum(np.append(begins[1:] - ends[:-1] > 1, False)))  # where words have more than a space between them
    for i in np.flatnonzero(gaps[stop - 1] > gaps[starts]).tolist():
        chunks[i] = b" ".join(chunks[i].split())
    mine = np.flatnonzero(place < owned[piece])
    return Parse(of[at].tolist(), chunks, (body - starts).tolist(), of[piece[mine]], codes[mine], distinct)


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The distinct chunks: ``lang, chunk, own, uses``; and, counted in the same pass, the distinct words, with ``own`` 0."""
    rows = spread(docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                              F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))

    def run(batches):
        for batch in batches:
            for some in slices(batch):
                got = parse(some.column(1).cast(pa.binary()).to_pylist())
                table = pa.table({"lang": some.column(0).take(pa.array(got.of, pa.int64())), "chunk": pa.array(got.chunks, pa.binary()), "own": pa.array(got.own, pa.int32())})
                table = table.group_by(["lang", "chunk", "own"]).aggregate([([], "count_all")])
                yield from _rows(table["lang"], table["chunk"], table["own"], table["count_all"])
                lang = some.column(0).dictionary_encode()
                key, count = np.unique(lang.indices.to_numpy()[got.word_of] * max(len(got.distinct), 1) + got.codes, return_counts=True)
                names = pa.array(got.distinct, pa.binary()).take(pa.array(key % max(len(got.distinct), 1)))
                yield from _rows(lang.dictionary.take(pa.array(key // max(len(got.distinct), 1))), names, pa.array(np.zeros(len(key), np.int32)), pa.array(count))

    return rows.mapInArrow(run, "lang string, chunk string, own int, uses bigint").groupBy("lang", "chunk", "own").agg(F.sum("uses").alias("uses"))


def _rows(lang, chunk, own, uses) -> Iterator[pa.RecordBatch]:
    return pa.table([lang, chunk.cast(pa.string()), own, uses], ["lang", "chunk", "own", "uses"]).to_batches(max_chunksize=50_000)


class Flat:
    """The words of some rows (language, words joined by single spaces) one after another."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        rows = texts.cast(pa.binary()).to_pylist()
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        self.text = b" ".join([*rows, b""])  # a space after every row, so that every word has one
        data = np.frombuffer(self.text, np.uint8)
        self.ends = np.flatnonzero(data == 32)
        self.begins = np.append(0, self.ends[:-1] + 1) if len(self.ends) else self.ends
        self.codes, distinct = _encode(data, self.begins, self.ends)
        self.distinct = len(distinct)
        self.hash = _word_hashes(distinct)[self.codes]
        close = np.searchsorted(self.ends, np.cumsum(size + 1) - 1)  # last word of each row
        self.length = np.diff(np.append(-1, close))
        lang = langs.dictionary_encode()
        self.langs = lang.dictionary.to_pylist()
        self.row = np.repeat(np.arange(len(rows)), self.length)
        self.lang = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[self.row]
        self.lang_hash = _word_hashes([x.encode() for x in self.langs])[self.lang]
        self.place = np.arange(len(self.codes)) - np.repeat(np.cumsum(self.length) - self.length, self.length)

    def phrase_hash(self, at: np.ndarray, n: int) -> np.ndarray:
        h = self.lang_hash[at]
        for j in range(n):
            h = (h ^ self.hash[at + j]) * _A
            h = h ^ (h >> np.uint64(29))
        return h * _B


def _bits(h: np.ndarray, size: int) -> list[np.ndarray]:
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(j) * high) & np.uint64(size - 1)).astype(np.int64) for j in range(PROBES)]


def _holds(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    got = np.ones(len(h), bool)
    for b in _bits(h, len(words) * 64):
        got &= (words[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) == 1
    return got


def bloom(phrases: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter over phrases of ``n`` words (``lang, phrase``) as 64-bit words; built on the executors, at most ``MOST_BITS``."""
    size = 1 << 16
    want = 16 * phrases.count()
    while size < min(want, MOST_BITS):
        size *= 2

    def run(batches):
        for batch in batches:
            flat = Flat(batch.column(0), batch.column(1))
            h = flat.phrase_hash(np.flatnonzero(flat.place == 0), n)
            b = np.unique(np.concatenate(_bits(h, size)))
            at, first = np.unique(b >> 6, return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (b & 63).astype(np.uint64), first) if len(b) else b
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(mask.view(np.int64))], names=["at", "mask"])

    got = phrases.select("lang", "phrase").mapInArrow(run, "at int, mask bigint").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[got["at"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return words


def count_phrases(flat: Flat, own: np.ndarray, uses: np.ndarray, n: int, frequent: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Languages, phrases and counts of the phrases of ``n`` words whose first word is owned and whose two parts of a word less
    the filter may hold."""
    own, length, weight = own[flat.row], flat.length[flat.row], uses[flat.row]
    at = np.flatnonzero((flat.place < own) & (flat.place + n <= length))
    at = at[_holds(frequent, flat.phrase_hash(at, n - 1))]
    at = at[_holds(frequent, flat.phrase_hash(at + 1, n - 1))]
    key = flat.lang[at]
    for j in range(n):  # two phrases have the same key exactly if they are equal
        key = pd.factorize(key)[0] * flat.distinct + flat.codes[at + j]
    codes, distinct = pd.factorize(key)
    count = np.zeros(len(distinct), np.int64)
    np.add.at(count, codes, weight[at])
    some = np.zeros(len(distinct), np.int64)
    some[codes] = at
    return flat.lang[some], [flat.text[a:b] for a, b in zip(flat.begins[some].tolist(), flat.ends[some + n - 1].tolist())], count


def _gathered(batches, limit: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def phrase_counts(chunks: DataFrame, n: int, least: int, frequent: np.ndarray) -> DataFrame:
    """``lang, phrase, size, f`` of all phrases of ``n`` words with at least ``least`` occurrences; ``frequent``: see ``bloom``."""
    held = chunks.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for some in _gathered(batches, GATHER):
            flat = Flat(some["lang"].combine_chunks(), some["chunk"].combine_chunks())
            lang, phrase, count = count_phrases(flat, some["own"].to_numpy().astype(np.int64), some["uses"].to_numpy(), n, held.value)
            names = pa.array(flat.langs, pa.string()).take(pa.array(lang))
            got = pa.table([names, pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(count)], ["lang", "phrase", "f"])
            yield from got.to_batches(max_chunksize=50_000)

    got = chunks.mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return got.where(F.col("f") >= least).select("lang", "phrase", F.lit(n).alias("size"), "f")


def frequent_phrases(chunks: DataFrame, least: int) -> DataFrame:
    """All phrases of up to ``LONGEST`` words with at least ``least`` occurrences: ``lang, phrase, size, f``."""
    words, chunks = chunks.where("own = 0"), chunks.where("own > 0")
    all_ = short = words.where(F.col("uses") >= least).select("lang", F.col("chunk").alias("phrase"), F.lit(1).alias("size"), F.col("uses").alias("f"))
    for n in range(2, LONGEST + 1):
        short = materialize(phrase_counts(chunks, n, least, bloom(short, n - 1)), "phrases")
        all_ = all_.unionByName(short)
    return all_


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best phrases of two to four words of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` is a phrase's count (at least ``least``), ``l`` and ``r`` those of the two parts of its lowest-scoring cut, ``n`` the
    language's words, ``score`` floor(2000000 a / (l + r)), exact.  Phrases inside a longer one with at least ``share`` % of
    their count are dropped; the first ``top`` by score, a (both falling) and phrase stay.
    """
    chunks = materialize(dictionary(docs, text_col, lang_col), "chunks")
    total = chunks.where("own = 0").groupBy("lang").agg(F.sum("uses").alias("n"))
    f = frequent_phrases(chunks, least)
    words = F.split("phrase", " ")
    candidates = f.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("w"))
    part = lambda name: f.select("lang", F.col("phrase").alias(name + "_part"), F.col("f").alias(name))
    text = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = candidates.select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "size", "a", "k", text(F.lit(1), F.col("k")).alias("l_part"), text(F.col("k") + 1, F.col("size") - F.col("k")).alias("r_part"))
    big = lambda c: f"cast({c} as decimal(20, 0))"
    scored = cuts.join(part("l"), ["lang", "l_part"]).join(part("r"), ["lang", "r_part"]).withColumn(
        "score", F.expr(f"(cast(2000000 as decimal(7, 0)) * {big('a')}) div ({big('l')} + {big('r')})"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.where("size > 2").select("lang", "a", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda s: text(s, m))))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(longer, ["lang", "phrase"], "left").where(
        F.expr(f"longer is null or 100 * {big('longer')} < {share} * {big('a')}")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
