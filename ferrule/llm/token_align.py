"""Alignment of two tokenizers' tokens on the same text, by ``merge_asof``.

A (a byte-level ``tokenizers`` file) reads a space and the text, B (a
``sentencepiece`` model, which puts that space itself) the text, so both
write the same bytes.  Per batch the tokens of both sides are two frames
sorted by their first byte and keyed by document; ``merge_asof`` finds for
each token's start the other side's token that covers it, and the union of
both directions is every pair of tokens that share a byte.  Pairs that also
end together cut the text into groups; a link is a pair of tokens of one
group.

What the corpus says about an id pair is the number of documents that hold
it linked.  Documents are stored with their distinct pairs (and how often
each occurs) in blocks of about ``BLOCK_BYTES`` of text; pairs are summed
within a block before they meet those of other blocks, and each block gets
the corpus-wide numbers of its own pairs back.  So a pair that nearly every
document holds is one row a block, and nothing is broadcast.

Long texts are encoded in units cut before a single space between letters,
where neither tokenizer's token can cross; both tokenizers are checked for
that when they are loaded (else a text is one unit).  Groups of many tokens
on both sides are counted by distinct ids, not token by token.

Defined cases: a null or empty text, and one whose tokens do not spell the
space and the text on both sides, has no tokens: zeros and an empty digest;
rows are not identified by their id, so repeated and null ids give one
result each and count as documents of their own.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.spread import materialize, spread
from .common import id_text, slices

MARK = "▁"  # fixed value: the format's mark for a space
UNIT = 1 << 18  # characters of a text encoded at once
RUN = 1 << 20  # characters aligned at once
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 1 << 16
WIDE = 1 << 12  # links of a group that are written out one by one
HALF = 32  # a pair is A's id shifted by this, or B's id
KEPT_WORDS = 300_000  # encodings kept per worker and side
_BORDER = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
_WORDS_B = re.compile(r" *[^ ]+(?: +\Z)?| +")  # cut before a space after another character, but for those at the end
#: Below this code point, and beside the four separators, the pattern's classes agree between the libraries.
PLAIN_BELOW = 0x530
_ODD = re.compile(f"[^\\x00-\\x1b\\x20-{chr(PLAIN_BELOW - 1)}]")


def _byte_of() -> dict[str, int]:
    """Character of the byte-level alphabet -> byte, in its usual order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def _strings(n: int, end: str) -> np.ndarray:
    out = np.empty(n, object)
    out[:] = [f"{i}{end}" for i in range(n)]
    return out


def _words_a() -> re.Pattern:
    """The byte-level pre-tokens of texts without odd characters."""
    import regex

    plain = [chr(c) for c in range(PLAIN_BELOW) if not 0x1C <= c <= 0x1F]
    L, N, S = ("".join(re.escape(c) for c in plain if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s"))
    # fixed value: the byte-level pattern, its classes written out
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+")


class Words:
    """Encodings of words of one side, kept as packed 32-bit ids (small objects, and texts are joined without a list of numbers)."""

    def __init__(self, encode, token_bytes: list[bytes], token_size: np.ndarray):
        self.encode, self.token_bytes, self.token_size = encode, token_bytes, token_size
        self.known: dict[str, bytes] = {}
        self.bad: set[str] = set()  # words that their ids do not spell

    def learn(self, words: list[str]) -> None:
        got = self.encode(words)
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.int32, int(size.sum()))
        packed, ends = flat.tobytes(), (4 * np.cumsum(size)).tolist()
        self.known.update(zip(words, map(packed.__getitem__, map(slice, [0, *ends[:-1]], ends))))
        raw = [w.encode() for w in words]
        spelled = np.add.reduceat(np.append(self.token_size[flat], 0), np.minimum(np.cumsum(size) - size, len(flat))) * (size > 0)
        if (spelled == np.fromiter(map(len, raw), np.int64, len(raw))).all() and b"".join(map(self.token_bytes.__getitem__, flat.tolist())) == b"".join(raw):
            return
        self.bad.update(w for w, r, ids in zip(words, raw, got) if b"".join(map(self.token_bytes.__getitem__, ids)) != r)

    def ids(self, texts: list[list[str]]) -> list[np.ndarray | None]:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
            self.bad.clear()
        if new := list(set(chain.from_iterable(texts)).difference(self.known)):
            self.learn(new)
        known = self.known.__getitem__
        return [None if self.bad and not self.bad.isdisjoint(words) else np.frombuffer(b"".join(map(known, words)), np.int32) for words in texts]


class Aligner:
    """Both tokenizers with the bytes of their tokens.  Words that neither side's tokens cross are encoded once and kept."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = _byte_of()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.fromiter(map(len, self.a_bytes), np.int64, len(self.a_bytes))
        self.b_size = np.fromiter(map(len, self.b_bytes), np.int64, len(self.b_bytes))
        self.a_ends = _strings(len(self.a_bytes), ","), _strings(len(self.a_bytes), "|")
        self.b_ends = _strings(len(self.b_bytes), ","), _strings(len(self.b_bytes), ";")
        # no piece of B has a space after another character, and A splits before a space first
        split = self.a.pre_tokenizer.pre_tokenize_str("é ñ") if self.a.pre_tokenizer and not self.a.normalizer else []
        self.cut = not any(MARK in p.lstrip(MARK) for p in pieces) and [at for _, at in split] == [(0, 1), (1, 3)]
        pattern = _words_a()
        probe = "It's  don't\t\n x1 22 a.b!! \xa0 é\u0301 ''s we'll \x85 "
        got = [probe[a:b] for _, (a, b) in self.a.pre_tokenizer.pre_tokenize_str(probe)] if self.cut else []
        self.split_a = pattern.findall if got == pattern.findall(probe) else None
        self.words_a = Words(lambda w: [e.ids for e in self.a.encode_batch_fast(w, add_special_tokens=False)], self.a_bytes, self.a_size)
        # B puts a space before each word: the words given to it have one less
        self.words_b = Words(lambda w: self.b.encode([x[1:] for x in w], num_threads=1), self.b_bytes, self.b_size)

    def units(self, text: str) -> Iterator[str]:
        """Parts of a text between spaces at which it is cut (those spaces left out)."""
        at = 0
        while self.cut and len(text) - at > UNIT and (m := _BORDER.search(text, at + UNIT)):
            yield text[at:m.start()]
            at = m.end()
        yield text[at:]

    def encode(self, units: list[str]) -> tuple[list[np.ndarray | None], list[np.ndarray | None]]:
        """Ids of both sides of each unit (with a space before it); None where they do not spell it."""
        whole = [" " + u for u in units]
        a = self.words_a.ids([self.split_a(t) if self.split_a and not _ODD.search(t) else [t] for t in whole])
        b = self.words_b.ids([_WORDS_B.findall(t) if self.cut else [t] for t in whole])
        return a, b


def overlaps(a_start: np.ndarray, a_doc: np.ndarray, b_start: np.ndarray, b_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens (by place) that share a byte: each token's start with the token of the other side that covers it."""
    a = pd.DataFrame({"start": a_start, "doc": a_doc, "a": np.arange(len(a_start))})
    b = pd.DataFrame({"start": b_start, "doc": b_doc, "b": np.arange(len(b_start))})
    of_a = pd.merge_asof(a[["start", "doc"]], b, on="start", by="doc")["b"].to_numpy(np.int64)
    of_b = pd.merge_asof(b[["start", "doc"]], a, on="start", by="doc")["a"].to_numpy(np.int64)
    new = np.flatnonzero(a_start[of_b] != b_start)  # tokens that start together are found from both sides
    return np.concatenate([np.arange(len(of_a)), of_b[new]]), np.concatenate([of_a, new])


class Run:
    """Aligned tokens of some units one after another, of which each belongs to a document."""

    def __init__(self, tool: Aligner, docs: list[int], a: list[np.ndarray], b: list[np.ndarray]):
        n_a, n_b = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
        doc = np.array(docs, np.int64)
        self.a, self.b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        self.a_doc, self.b_doc = np.repeat(doc, n_a), np.repeat(doc, n_b)
        a_end, b_end = np.cumsum(tool.a_size[self.a]), np.cumsum(tool.b_size[self.b])
        x, y = overlaps(a_end - tool.a_size[self.a], self.a_doc, b_end - tool.b_size[self.b], self.b_doc)
        self.x, self.y = x, y
        same = a_end[x] == b_end[y]
        last = np.sort(x[same])  # A tokens that end a group
        ends = a_end[last]
        self.a_group, self.b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        self.group_doc = self.a_doc[last]
        self.m, self.n = np.bincount(self.a_group, minlength=len(ends)), np.bincount(self.b_group, minlength=len(ends))
        self.a_first, self.b_first = np.cumsum(self.m) - self.m, np.cumsum(self.n) - self.n
        self.tool = tool

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of each document in order: document, pair, times."""
        wide = self.m * self.n > WIDE
        times = np.where(wide, 0, self.n)[self.a_group]  # B tokens of each A token
        a = np.repeat(np.arange(len(self.a)), times)
        nth = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
        b = self.b_first[self.a_group[a]] + nth
        width = len(self.tool.b_bytes)
        span = len(self.tool.a_bytes) * width
        key, count = np.unique(self.a_doc[a] * span + self.a[a] * width + self.b[b], return_counts=True)
        more = [(key, count)]
        for g in np.flatnonzero(wide):
            ia, ca = np.unique(self.a[self.a_first[g]:self.a_first[g] + self.m[g]], return_counts=True)
            ib, cb = np.unique(self.b[self.b_first[g]:self.b_first[g] + self.n[g]], return_counts=True)
            more.append(((self.group_doc[g] * span + ia[:, None] * width + ib[None, :]).ravel(), (ca[:, None] * cb[None, :]).ravel()))
        if len(more) > 1:
            key, count = _summed([k for k, _ in more], [c for _, c in more])
        pair = key % span
        return key // span, (pair // width) << HALF | pair % width, count

    def text(self) -> list[str]:
        """The groups' ids of A and B, token by token, each with the sign that follows it."""
        out = np.empty(len(self.a) + len(self.b), object)
        place = np.arange(len(self.a))
        last = place + 1 == (self.a_first + self.m)[self.a_group]
        out[place + self.b_first[self.a_group]] = np.where(last, self.tool.a_ends[1][self.a], self.tool.a_ends[0][self.a])
        place = np.arange(len(self.b))
        last = place + 1 == (self.b_first + self.n)[self.b_group]
        out[place + (self.a_first + self.m)[self.b_group]] = np.where(last, self.tool.b_ends[1][self.b], self.tool.b_ends[0][self.b])
        return out.tolist()


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return key, total


class Doc:
    """What the runs say of one document."""

    def __init__(self):
        self.sizes = np.zeros(4, np.int64)  # tokens of A and of B, groups, links
        self.hash, self.held = hashlib.sha256(), ""
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, sizes, text, pairs, times):
        self.sizes += sizes
        self.hash.update(self.held.encode())
        self.held = text
        self.pairs.append(pairs)
        self.times.append(times)

    def row(self) -> tuple:
        if not self.sizes[0]:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.hash.update(self.held[:-1].encode())  # without the sign after the last group
        pairs, times = (self.pairs[0], self.times[0]) if len(self.pairs) == 1 else _summed(self.pairs, self.times)
        return *self.sizes.tolist(), self.hash.hexdigest(), pairs, times


def _runs(tool: Aligner, texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for d, t in enumerate(texts):
        for u in tool.units(t) if t else ():
            held.append((d, u))
            size += len(u)
            if size >= RUN:
                yield held
                held, size = [], 0
    if held:
        yield held


def align_texts(tool: Aligner, texts: list[str]) -> list[tuple]:
    """Per text: tokens of A and B, groups, links, digest of the groups, distinct pairs and how often each is linked."""
    docs, bad = [Doc() for _ in texts], set()
    for units in _runs(tool, texts):
        a, b = tool.encode([u for _, u in units])
        bad |= {d for (d, _), x, y in zip(units, a, b) if x is None or y is None}
        good = [i for i, (d, _) in enumerate(units) if d not in bad]
        if not good:
            continue
        run = Run(tool, [units[i][0] for i in good], [a[i] for i in good], [b[i] for i in good])
        which, pair, times = run.links()
        text, at = run.text(), 0
        n = len(texts)
        sizes = np.stack([np.bincount(run.a_doc, minlength=n), np.bincount(run.b_doc, minlength=n), np.bincount(run.group_doc, minlength=n)], 1)
        total = np.zeros(n, np.int64)
        np.add.at(total, run.group_doc, run.m * run.n)
        for d in np.flatnonzero(sizes[:, 0]).tolist():
            k = int(sizes[d, 0] + sizes[d, 1])
            lo, hi = np.searchsorted(which, [d, d + 1])
            docs[d].add([*sizes[d], total[d]], "".join(text[at:at + k]), pair[lo:hi], times[lo:hi])
            at += k
    return [(Doc() if d in bad else doc).row() for d, doc in enumerate(docs)]


_TOOLS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner for two files (kept between tasks)."""
    if (a_path, b_path) not in _TOOLS:
        _TOOLS[a_path, b_path] = Aligner(a_path, b_path)
    return _TOOLS[a_path, b_path]


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``block, doc_id, n_a, n_b, n_groups, n_links, groups_sha256``, its distinct linked id ``pairs`` (A's id shifted
    by 32 bits, or B's) and how many ``times`` each is linked.  Both files must exist on every worker."""
    rows = spread(id_text(docs, id_col, text_col))
    fields = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"

    def lists(parts):
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts), pa.int64()))

    def run(batches):
        from pyspark import TaskContext

        tool, block, size, held = aligner(a_path, b_path), TaskContext.get().partitionId() << 40, 0, 0
        for batch in batches:
            for some in slices(batch, limit=RUN):
                got = list(zip(*align_texts(tool, [t or "" for t in some.column(1).to_pylist()])))
                yield pa.RecordBatch.from_arrays([pa.array([block] * some.num_rows, pa.int64()), some.column(0), *[pa.array(x, pa.int64()) for x in got[:4]],
                                                  pa.array(got[4], pa.string()), lists(got[5]), lists(got[6])],
                                                 names=["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                size, held = size + some.column(1).nbytes, held + some.num_rows
                if size >= BLOCK_BYTES or held >= BLOCK_ROWS:
                    block, size, held = block + 1, 0, 0

    return rows.mapInArrow(run, f"block bigint, doc_id {rows.schema[0].dataType.simpleString()}, {fields}")


def block_pairs(table: DataFrame) -> DataFrame:
    """``block, pair, docs``: how many documents of a block hold a pair linked."""

    def run(batches):
        for batch in batches:
            block, pairs = batch.column(0).to_numpy(), batch.column(1)
            of, pair = np.repeat(block, pairs.value_lengths().to_numpy()), pairs.flatten().to_numpy()
            for b in np.unique(block):
                p, n = np.unique(pair[of == b], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), b)), pa.array(p), pa.array(n)], names=["block", "pair", "docs"])

    return table.select("block", "pairs").mapInArrow(run, "block bigint, pair bigint, docs bigint").groupBy("block", "pair").agg(F.sum("docs").alias("docs"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``pair, count`` (documents corpus-wide that hold it linked), ``best`` (whether no pair of the same A id has more)."""
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", HALF)))
    return counts.withColumn("best", F.col("count") == most)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_a, n_b, n_groups, n_links, n_best`` (links whose pair is its A id's most frequent, ties included),
    ``count_sum`` (of the pairs' counts over the links), ``groups_sha256`` ('' without tokens)."""
    table = materialize(aligned(docs, a_path, b_path, id_col, text_col), "aligned")
    pairs = materialize(block_pairs(table), "pairs")
    known = pairs.select("block", "pair").join(pair_counts(pairs), "pair").select("block", "pair", "count", "best")
    out = f"doc_id {table.schema['doc_id'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"

    def numbers(rows: pa.Table, own: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        own = own.sort_by("pair")
        lists = rows["pairs"].combine_chunks()
        times = rows["times"].combine_chunks().flatten().to_numpy()
        at = np.searchsorted(own["pair"].to_numpy(), lists.flatten().to_numpy())
        ends = np.cumsum(np.append(0, lists.value_lengths().to_numpy()))
        per = lambda x: pa.array(np.diff(np.append(0, np.cumsum(x * times))[ends]))
        n_best = per(own["best"].to_numpy(zero_copy_only=False)[at].astype(np.int64))
        return pa.table([*[rows[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], n_best, per(own["count"].to_numpy()[at]), rows["groups_sha256"]],
                        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return table.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(numbers, out)
