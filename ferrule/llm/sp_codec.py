"""SentencePiece encoding and decoding (merge-type models) by backtracking.

A merge-type encoding is the only sequence of tokens in which every adjacent
pair is *compatible*: re-merging the characters of the two tokens gives the
same two tokens again.  So the encoder walks the text with the longest token
at each position (Aho-Corasick), takes it if it is compatible with the token
before it, else the next shorter prefix token; where none fits, the position
is marked failed in a bitfield and the last token is retried shorter.  Each
position fails at most once, so the time is linear in the text.

Characters outside the vocabulary are one-character tokens written as their
UTF-8 byte pieces.  Texts are cut before a space mark that follows another
character when no piece of the vocabulary crosses such a place; the pieces
between are encoded once per worker and kept in a bounded table.
"""

from __future__ import annotations

import codecs
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, map_batches, sha, texts

MARK = "▁"  # fixed value: the format's mark for a space
CACHE_ENTRIES = 200_000  # words kept per worker
SLICE_IDS = 2 << 20  # bytes of text whose id lists are held at once
PIECE = 1 << 20  # characters of a text whose words are held at once
PAIR_ENTRIES = 300_000  # compatibility checks kept per worker


def _one_byte(err):
    return "�", err.start + 1


codecs.register_error("one_byte", _one_byte)


class Words(dict):
    """Encodings of words, made when first asked for; emptied when full."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        got = self.make(word)
        if len(word) <= 256:
            self[word] = got
        return got


class Codec:
    """Exact encoder and decoder of one merge-type model with byte pieces and no text rewriting."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.encode("aÅﬁ  b ", out_type=str) != sp.encode("aÅﬁ  b ", out_type=str, enable_sampling=False):
            raise ValueError("sampling model")
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        odd = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        self.bytes_of = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes_of) != 256 or any(sp.is_unused(i) for i in range(n)):
            raise ValueError("the model needs all byte pieces and no unused piece")
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in odd}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.cut = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.pairs: dict[tuple[str, str], bool] = {}
        # only pieces that their own characters merge into can occur in an encoding
        self.steps: dict[str, tuple] = {}  # of each such piece: its merges in order
        for p in self.ids:
            parts, steps = self.merge(p)
            if parts == [p]:
                self.steps[p] = steps
        real = list(self.steps)
        self.machine = ahocorasick.Automaton()
        for p in real:
            self.machine.add_word(p, (len(p) - 1, p))
        self.machine.make_automaton()
        known = set(real)
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in known), p[0] if len(p) > 1 else None)
                        for p in real}
        # decoding: a byte piece of 128 or more stands as an escaped byte until all pieces are joined
        text = {}
        for i, p in enumerate(self.pieces):
            text[str(i)] = p.replace(MARK, " ") if i not in odd else ""
        text[str(sp.unk_id())] = " ⁇ "
        for b, i in self.bytes_of.items():
            text[str(i)] = chr(b) if b < 128 else chr(0xDC00 + b)
        self.text = text
        self.words = Words(self.word, CACHE_ENTRIES)
        self.number = Words(lambda c: ",".join(str(self.bytes_of[b]) for b in c.encode()), 2_000_000)  # of a character: its bytes
        self.number.update({p: str(i) for p, i in self.ids.items()})
        self.splitter = self.cuts()
        self.border = re.compile(f"(?<!{MARK}){MARK}")

    def cuts(self) -> re.Pattern:
        """Cuts a marked text where no piece has both neighbours side by side, so that no merge can cross:
        before a mark after another character, before those digits and signs that no piece has after
        anything but such signs and marks, and around control characters that no piece has."""
        used = set("".join(self.ids))
        after = {}
        for p in self.ids:
            for x, y in zip(p, p[1:]):
                after.setdefault(y, set()).add(x)
        alone = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in used)
        punct = {c for c in used if not c.isalpha() and c != MARK}
        while bad := {c for c in punct if after.get(c, set()) - punct - {MARK}}:
            punct -= bad
        c = "".join(map(re.escape, sorted(punct)))
        first = f"[{alone}]+|" if alone else ""
        tail = f"|[{c}]+[^{MARK}{c}{alone}]*" if c else ""
        return re.compile(f"{first}{MARK}*(?:[^{MARK}{c}{alone}]+{tail})|{MARK}+")

    def merge(self, chars: str) -> tuple[list[str], tuple]:
        """Merging from single characters, best score first, leftmost among equals: the tokens, and each
        merge as (score, first part after it, last part after it), a part being None if unchanged."""
        parts, score, steps = list(chars), self.score, []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[0] if at == 0 else None, parts[-1] if at == len(parts) - 1 else None))
        return parts, tuple(steps)

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of both tokens leaves these two: their own merges are replayed
        together in the order of merging, until one across the border would come first."""
        key = (left, right)
        got = self.pairs.get(key)
        if got is not None:
            return got
        if len(self.pairs) >= PAIR_ENTRIES:
            self.pairs.clear()
        score, lows = self.score, float("-inf")
        a, b = self.steps.get(left, ()), self.steps.get(right, ())
        i, j, end, start = 0, 0, left[-1], right[0]
        cross = score.get(end + start, lows)
        while True:
            sa = a[i][0] if i < len(a) else lows
            sb = b[j][0] if j < len(b) else lows
            if cross > sa and cross >= sb and cross != lows:
                got = False
                break
            if sa == lows and sb == lows:
                got = True
                break
            if sa >= sb:
                part = a[i][2]
                i += 1
                if part is not None:
                    end = part
                    cross = score.get(end + start, lows)
            else:
                part = b[j][1]
                j += 1
                if part is not None:
                    start = part
                    cross = score.get(end + start, lows)
        self.pairs[key] = got
        return got

    def tokens(self, word: str) -> list[str]:
        """Tokens of ``word`` by backtracking over the longest matches."""
        n = len(word)
        longest: list = list(word)
        for end, (back, piece) in self.machine.iter(word):  # of one start, the longest ends last
            longest[end - back] = piece
        out: list[str] = []
        shorter, pairs, compatible = self.shorter.get, self.pairs, self.compatible
        failed, pos, last = 0, 0, None  # failed: a bitfield of positions
        token = longest[0] if n else None
        while pos < n:
            while token is not None:
                end = pos + len(token)
                if not (failed and failed >> end & 1):
                    if last is None:
                        break
                    fits = pairs.get((last, token))
                    if fits is None:
                        fits = compatible(last, token)
                    if fits:
                        break
                token = shorter(token)
            if token is not None:
                out.append(token)
                last, pos = token, end
                token = longest[pos] if pos < n else None
            else:
                failed |= 1 << pos
                token = out.pop()
                last = out[-1] if out else None
                pos -= len(token)
        return out

    def word(self, word: str) -> str:
        """Decimal ids of a word, joined by commas."""
        return ",".join(map(self.number.__getitem__, self.tokens(word)))

    def encode(self, text: str) -> str:
        """Decimal ids of a text, joined by commas ('' for an empty text)."""
        if not text:
            return ""
        whole = MARK + text.replace(" ", MARK)
        if not self.cut:
            return self.words[whole]
        out, pos = [], 0
        while pos < len(whole):  # a long text goes on from a mark after another character, where no piece crosses
            at = self.border.search(whole, pos + PIECE) if len(whole) > pos + PIECE else None
            end = at.start() if at else len(whole)
            out.append(",".join(map(self.words.__getitem__, self.splitter.findall(whole, pos, end))))
            pos = end
        return ",".join(out)

    def decode(self, ids: str) -> bytes:
        """UTF-8 text of decimal ids joined by commas; a broken byte becomes U+FFFD."""
        if not ids:
            return b""
        joined = "".join(map(self.text.__getitem__, ids.split(",")))
        if joined.startswith(" "):
            first = next(i for i in ids.split(",") if self.text[i])
            if self.pieces[int(first)].startswith(MARK):
                joined = joined[1:]  # the mark that encoding put before the text
        raw = joined.encode("utf-8", "surrogateescape")
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "one_byte").encode()
        return raw


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a model file (kept between tasks)."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids`` (list), ``decoded`` (text of the ids) and the digests of both.

    ``model_path`` must exist on every worker.  A null or empty text has no
    ids and an empty decoding; repeated rows give repeated results; ids may be
    null.  One pass without a shuffle, text pieces bounded in memory.
    """

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(model_path)
        joined = [c.encode(t) for t in texts(batch)]
        n = [s.count(",") + 1 if s else 0 for s in joined]
        ids = np.concatenate([np.fromstring(s, np.int32, sep=",") for s in joined])
        back = [c.decode(s) for s in joined]
        return {"doc_id": batch.column(0), "n_tokens": n, "ids": pa.ListArray.from_arrays(np.cumsum([0, *n]).astype(np.int32), ids),
                "decoded": [b.decode() for b in back], "ids_sha256": [sha(s.encode()) for s in joined], "decoded_sha256": [sha(b) for b in back]}

    rows = id_text(docs, id_col, text_col)
    return map_batches(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens bigint, ids array<int>, "
                                  "decoded string, ids_sha256 string, decoded_sha256 string", limit=SLICE_IDS)


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents``, with digests in place of the ids and the text."""

    def run(batch: pa.RecordBatch) -> dict:
        c = codec(model_path)
        joined = [c.encode(t) for t in texts(batch)]
        return {"doc_id": batch.column(0), "n_tokens": [s.count(",") + 1 if s else 0 for s in joined],
                "ids_sha256": [sha(s.encode()) for s in joined], "decoded_sha256": [sha(c.decode(s)) for s in joined]}

    rows = id_text(docs, id_col, text_col)
    return map_batches(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
