"""Token counts by rank-synchronous merging over ragged numpy arrays.

The distinct pre-tokens of a batch that are new to the worker are laid out
one after another in one symbol array.  Every step finds the lowest-rank
neighbouring pair of each pre-token (one ``minimum.reduceat``) and merges all
its non-overlapping occurrences, leftmost first, in all pre-tokens at once;
a pre-token is finished when no pair has a rank.  What is left is counted.
Merging all occurrences of the pair at once equals merging them one by one
when no merge makes a pair of lower rank; the rank table is checked for that
when it is loaded, and otherwise only the leftmost occurrence is merged.

Counts of pre-tokens are kept in a bounded table per worker.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_batches, texts

PIECE = 1 << 20  # characters of a text whose pre-tokens are held at once
SPACE = re.compile("[ \n]")
KEPT_WORDS = 600_000  # counts kept per worker
#: Below this code point the pattern's classes agree between the libraries; above it the tokenizer's own
#: rewriting and splitting are used.
PLAIN_BELOW = 0x530


class RankCounter:
    """Counts the symbols that merging leaves of pre-tokens, for a tokenizer file of word-end merges."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.size = len(vocab)
        # byte -> character of the byte-level alphabet, in its usual order
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(shown))}
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[char[b] + end] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys = (left * self.size + right)[order]
        self.rank, self.made = order.astype(np.int64), made
        first = np.full(self.size, len(merges), np.int64)  # of a symbol: the lowest rank that has it as a part
        np.minimum.at(first, left, np.arange(len(merges)))
        np.minimum.at(first, right, np.arange(len(merges)))
        self.all_at_once = bool((first[made] > np.arange(len(merges))).all())
        self.specials = {t["content"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))))
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        plain = [chr(c) for c in range(PLAIN_BELOW)]
        sets = {r"\p{L}": "", r"\p{N}": "", r"\s": ""}
        for k in sets:
            sets[k] = "".join(re.escape(c) for c in plain if regex.match(k, c))
        self.pattern = re.compile(re.sub(r"\[?\\p\{L\}\]\+", "[" + sets[r"\p{L}"] + "]+", pattern.replace(
            r"[^\s\p{L}\p{N}]", "[^" + "".join(sets.values()) + "]")).replace(r"[\p{N}]", "[" + sets[r"\p{N}"] + "]"))
        self.wide = re.compile(f"[^\\x00-{chr(PLAIN_BELOW - 1)}]")
        self.known: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if text.isascii():
            return self.pattern.findall(text.lower())
        plain = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if self.wide.search(text) or self.wide.search(plain):
            text = self.lib.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern.findall(plain)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.keys))

    def count(self, words: list[str]) -> np.ndarray:
        """Symbols left of each pre-token (none may be empty)."""
        raw = [w.encode() for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(length) - 1
        sym = self.inner[data]
        sym[ends] = self.last[data[ends]]
        seq = np.repeat(np.arange(len(raw)), length)
        total, none = length.copy(), len(self.keys)

        def border(rank, seq):
            rank[:-1][seq[:-1] != seq[1:]] = none
            rank[-1:] = none
            return rank

        rank = border(np.append(self.ranks(sym[:-1], sym[1:]), none), seq)
        while len(sym):
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            sizes = np.diff(np.append(starts, len(seq)))
            low = np.minimum.reduceat(rank, starts)
            live = np.repeat(low < none, sizes)
            if not live.all():  # finished pre-tokens leave the arrays
                done = low == none
                total[seq[starts[done]]] = sizes[done]
                sym, seq, rank = sym[live], seq[live], rank[live]
                if not len(sym):
                    break
                low, sizes = low[~done], sizes[~done]
            hit = rank == np.repeat(low, sizes)
            if self.all_at_once:
                run = hit & np.append(False, hit[:-1])  # a pair that overlaps the one before it
                if run.any():
                    i = np.arange(len(hit))
                    begin = np.maximum.accumulate(np.where(hit & ~run, i, 0))
                    hit &= (i - begin) % 2 == 0
            else:
                first = np.flatnonzero(hit)
                first = first[np.append(True, seq[first][1:] != seq[first][:-1])]
                hit = np.zeros(len(hit), bool)
                hit[first] = True
            at = np.flatnonzero(hit)
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            fresh = np.zeros(len(sym), bool)  # pairs that have changed
            fresh[at] = True
            before = at[at > 0] - 1
            fresh[np.where(keep[before], before, before - 1)] = True
            sym, seq, rank, fresh = sym[keep], seq[keep], rank[keep], fresh[keep]
            at = np.flatnonzero(fresh)
            nxt = np.minimum(at + 1, len(sym) - 1)
            new = self.ranks(sym[at], sym[nxt])
            new[(seq[at] != seq[nxt]) | (nxt == at)] = none
            rank[at] = new
        return total

    def counts(self, batch: list[str]) -> list[int]:
        """Tokens of each text.  A long one goes on from white space, which no pre-token or special string holds."""
        out = []
        for t in batch:
            n = 0
            while len(t) > PIECE and (m := SPACE.search(t, PIECE)):
                n += self.some_counts([t[:m.start()]])[0]
                t = t[m.start():]
            out.append((n, t))
        return [n + k for (n, _), k in zip(out, self.some_counts([t for _, t in out]))]

    def some_counts(self, batch: list[str]) -> list[int]:
        parts, extra = [], []
        for t in batch:
            n = 0
            if any(s in t for s in self.specials):
                n = len(self.special.findall(t))
                parts.append(list(chain.from_iterable(map(self.words, self.special.split(t)))))
            else:
                parts.append(self.words(t))
            extra.append(n)
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        new = list(set(chain.from_iterable(parts)).difference(known))
        for i in range(0, len(new), 100_000):
            some = new[i:i + 100_000]
            known.update(zip(some, self.count(some).tolist()))
        return [n + sum(map(known.__getitem__, p)) for n, p in zip(extra, parts)]


_COUNTERS: dict[str, RankCounter] = {}


def counter(path: str) -> RankCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = RankCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens).

    The file must exist on every worker.  A null or empty text counts 0;
    special strings inside a text count one each, as the library does by
    default; repeated rows give repeated results; ids may be null.  One pass
    without a shuffle.
    """

    def run(batch: pa.RecordBatch) -> dict:
        ts = texts(batch)
        n = counter(tokenizer_path).counts(ts)
        return {"doc_id": batch.column(0), "n_bytes": [len(t.encode()) for t in ts], "n_tokens": n, "over_limit": [k > limit for k in n]}

    rows = id_text(docs, id_col, text_col)
    return map_batches(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
