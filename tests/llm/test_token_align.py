import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from .cases import edge_docs, edge_rows, no_docs, words
from .test_documents import key, result

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def tool():
    from ferrule.llm.token_align import Aligner

    return Aligner(A, B)


def plain(tool, texts):
    """Groups by looking at every byte; links as all pairs of a group."""
    rows = []
    for t in texts:
        whole = b" " + (t or "").encode()
        a = tool.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = tool.b.encode(t) if t else []
        ab, bb = [tool.a_bytes[i] for i in a], [tool.b_bytes[i] for i in b]
        if not t or b"".join(ab) != whole or b"".join(bb) != whole:
            rows.append(([], []))
            continue
        ea, eb = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        cuts = sorted(set(ea) & set(eb))
        groups, i, j = [], 0, 0
        in_a, in_b = ({e: n + 1 for n, e in enumerate(x)} for x in (ea, eb))
        for c in cuts:
            x, y = in_a[c], in_b[c]
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        rows.append((groups, [Counter((p, q) for g in groups for p in g[0] for q in g[1])]))
    docs = Counter(p for _, c in rows if c for p in c[0])
    most = {}
    for (p, _), n in docs.items():
        most[p] = max(most.get(p, 0), n)
    out = []
    for groups, c in rows:
        c = c[0] if c else Counter()
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(c.values()),
                    sum(n for p, n in c.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in c.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


ODD = ["漢字 かな", "a ▁ b", "▁", "ééé ñ 😀😀 a", "<|endoftext|> x <s> </s> <unk> <0x41>", "  two  spaces ", "\n\n\t tab", " ", "a\x00b", "1234567890 12 3",
       "zqzqzqzq" * 20, "𝒳𝒴𝒵 ﬁ Å", "don't we'll", "=" * 90, "  \xa0 x", "ABCÀÉ", "한국어 텍스트"]


@pytest.mark.parametrize("unit, run, wide", [(1 << 18, 1 << 20, 1 << 12), (12, 40, 2)])
def test_alignment_equals_brute_force(spark, tool, monkeypatch, unit, run, wide):
    from ferrule.llm import token_align as T

    assert tool.cut
    for k, v in [("UNIT", unit), ("RUN", run), ("WIDE", wide), ("BLOCK_BYTES", run)]:
        monkeypatch.setattr(T, k, v)
    r = random.Random(2)
    texts = ODD + ["", None] + [" ".join(r.choice(ODD + ["the", "of", "and", "License", "naïve"]) for _ in range(r.randint(1, 30))) for _ in range(25)]
    texts += [words(s, 60) for s in range(3)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    assert result(T.align(docs, A, B), *COLUMNS) == [(i, *p) for i, p in enumerate(plain(tool, texts))]


def test_overlaps_are_all_pairs_that_share_a_byte():
    from ferrule.llm.token_align import overlaps

    r = random.Random(1)
    for _ in range(50):
        n = [r.randint(1, 30) for _ in range(r.randint(1, 4))]  # bytes of the documents
        sides = []
        for _ in "ab":
            start = [sum(n[:d]) + x for d in range(len(n)) for x in sorted({0, *r.sample(range(n[d]), r.randint(0, n[d] - 1))})]
            sides.append((np.array(start), np.array([max(d for d in range(len(n)) if sum(n[:d]) <= s) for s in start]), start[1:] + [sum(n)]))
        (a, da, ea), (b, db, eb) = sides
        x, y = overlaps(a, da, b, db)
        assert set(zip(x.tolist(), y.tolist())) == {(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] < eb[j] and b[j] < ea[i]}


def test_edges(spark, tool):
    from ferrule.llm.token_align import align

    got = result(align(edge_docs(spark), A, B), *COLUMNS)
    rows = edge_rows()
    assert got == sorted(((r[0], *p) for r, p in zip(rows, plain(tool, [r[1] for r in rows]))), key=key)
    assert align(no_docs(spark), A, B).count() == 0
    only = spark.createDataFrame([("x", None), (None, "")], "name string, body string")
    assert result(align(only, A, B, "name", "body"), *COLUMNS) == [(None, 0, 0, 0, 0, 0, 0, ""), ("x", 0, 0, 0, 0, 0, 0, "")]
