import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from .cases import edge_docs, no_docs, words
from .test_documents import key, result

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least, top, share=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    longer = {}
    for (lang, p), a in found.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                q = lang, p[i:i + m]
                longer[q] = max(longer.get(q, 0), a)
    out = []
    for (lang, p), a in found.items():
        if 100 * longer.get((lang, p), 0) >= share * a and (lang, p) in longer:
            continue
        score, k, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), a, l, r))
    out.sort()
    at, got = Counter(), []
    for lang, s, _, p, a, l, r in out:
        at[lang] += 1
        if at[lang] <= top:
            got.append((lang, at[lang], p.decode(), a, l, r, n[lang], -s))
    return sorted(got, key=key)


def corpus(seed, docs):
    r = random.Random(seed)
    voc = ["a", "b", "C", "dé", "e-f", "漢字", "g\x1ch", "i j"]
    shared = [" ".join(r.choice(voc) for _ in range(40)) for _ in range(3)]
    rows = []
    for _ in range(docs):
        t = "".join(r.choice(voc) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!"]) for _ in range(r.randint(0, 60)))
        rows.append((t + (" " + r.choice(shared) if r.random() < 0.4 else ""), r.choice(["en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "fr"), ("...", None)] + rows[:20] + [("Big Loud dog", "en")] * 50


@pytest.mark.parametrize("segment, every, bits", [(1 << 20, 16, 1 << 28), (40, 3, 1 << 16)])
def test_collocations_equal_brute_force(spark, monkeypatch, segment, every, bits):
    from ferrule.llm import collocations as C

    for k, v in [("EVERY", every), ("SEGMENT", segment), ("MOST_BITS", bits)]:
        monkeypatch.setattr(C, k, v)
    for seed, least, top in [(1, 5, 40), (2, 2, 2000)]:
        rows = corpus(seed, 200)
        df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, chunk string")
        assert result(C.collocations(df, least, top), *COLUMNS) == plain(rows, least, top)


def test_parse_owns_every_word_once(monkeypatch):
    from ferrule.llm import collocations as C

    monkeypatch.setattr(C, "EVERY", 3)
    for segment in (10, 37, 1 << 20):
        monkeypatch.setattr(C, "SEGMENT", segment)
        texts = [(t or "").encode() for t, _ in corpus(5, 60)] + [words(3, 500).encode(), b"x" * 100, b" \n ", b"a\n b"]
        of, chunks, own, *_ = C.parse(texts)
        for n, t in enumerate(texts):
            pieces = [p.split() for p in re.split(rb"[.,;:!?\n\x0b\x0c\r]", t.lower().replace(b"\t", b" "))]
            mine = [(c.split(b" "), k) for o, c, k in zip(of, chunks, own) if o == n]
            assert [w for c, k in mine for w in c[:k]] == [w for p in pieces for w in p]
            want = Counter(tuple(p[i:i + 4]) for p in pieces for i in range(len(p) - 3))
            assert Counter(tuple(c[i:i + 4]) for c, k in mine for i in range(min(k, len(c) - 3))) == want


def test_shared_passages_share_chunks(spark):
    from ferrule.llm.collocations import dictionary

    passage = words(11, 2000)
    rows = [(i, words(100 + i, 30) + " " + passage, "en") for i in range(40)]
    d = dictionary(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert d.where("own = 0").agg(F.sum("uses")).first()[0] == 40 * 2030
    d = d.where("own > 0")
    assert d.count() < 500 and d.where(F.col("uses") >= 40).count() > 80


def test_edges_and_no_rows(spark):
    from ferrule.llm.collocations import collocations

    got = result(collocations(edge_docs(spark), 3, 100), *COLUMNS)
    from .cases import edge_rows

    assert got == plain([(r[1], r[2]) for r in edge_rows()], 3, 100) and got
    assert collocations(no_docs(spark)).count() == 0


def test_scores_beyond_64_bits(spark, monkeypatch):
    from ferrule.llm import collocations as C

    big = 1 << 58
    chunks = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, 5), ("en", "a", 0, big + 5), ("en", "b", 0, big)], "lang string, chunk string, own int, uses bigint")
    monkeypatch.setattr(C, "dictionary", lambda *a: chunks)
    got = C.collocations(chunks).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", big, big + 5, big, 2 * big + 5, 2_000_000 * big // (2 * big + 5))]
