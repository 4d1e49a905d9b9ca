import random
import re

import pytest

from .cases import CLASH, edge_docs, edge_rows, no_docs, words
from .test_documents import key, result

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return [w.decode() for w in WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))]


def plain_scan(text, templates, slack=3):
    """Spans of a text by looking at every place for every k-gram."""
    w, spans = plain_words(text), []
    for t in templates:
        tw = t.words.split(" ")
        k = min(t.k, len(tw))
        diagonals = {}
        for q in range(len(tw) - k + 1):
            for p in range(len(w) - k + 1):
                if w[p:p + k] == tw[q:q + k]:
                    diagonals.setdefault(p - q, []).append(q)
        runs = []
        for d in sorted(diagonals):
            if runs and t.least < 1 and d - runs[-1][-1] <= slack:
                runs[-1].append(d)
            else:
                runs.append([d])
        for run in runs:
            covered = {q + j for d in run for q in diagonals[d] for j in range(k)}
            if len(covered) / len(tw) >= t.least:
                first = min(d + q for d in run for q in diagonals[d])
                end = max(d + q + k for d in run for q in diagonals[d])
                spans.append((t.label, t.base, first, end, len(covered) / len(tw)))
    return len(w), spans


def plain_row(text, templates):
    n, spans = plain_scan(text, templates)
    at = [s[2] for s in spans if s[1]]
    return (n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({s[0] for s in spans if s[1]})),
            ",".join(sorted({s[0] for s in spans})), max((s[4] for s in spans), default=0.0))


COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def cases():
    from ferrule.llm.licenses import NOTICES

    mit, bsd = NOTICES[0].words, NOTICES[5].words
    changed = mit.split()
    changed[7:7] = ["very", "new"]  # words put in move the diagonal
    del changed[20]
    half = " ".join(mit.split()[: len(mit.split()) // 2])
    return [
        (100, "Released under the MIT License.", "en"), (101, "mit\nlicense MIT  License, mit-license; Apache license", "en"),
        (102, "the general public license and the General Public License", "en"), (103, "Mitlicense mit licenses mit", "en"),
        (104, mit.upper().replace(" ", ", "), "en"), (105, " ".join(changed), "en"), (106, half, "en"), (107, bsd + " " + mit, None),
        (108, "licensed under CC BY 4.0 or licensed under CC BY-NC 4.0", "en"), (109, " ".join(["mit license"] * 3000), "en"),
        (110, words(7, 2047) + " mit license " + words(8, 2046) + " apache license", "en"), (111, "mit", "en"),
        (112, words(9, 2046) + " gnu affero general public license", "en"), (113, "general public\x00license é general public license é", "en"),
        (113, "another text under the mit license", "en"), (113, "another text under the mit license", "en"), (None, "mit license", "en"),
        (None, "apache license", "en"), (None, None, "en"),
    ]


def test_scan_equals_brute_force(spark):
    from ferrule.llm.licenses import TEMPLATES, scan_licenses

    rows = [(*r, *["x"] * len(CLASH)) for r in cases()]
    docs = edge_docs(spark).unionByName(spark.createDataFrame(rows, edge_docs(spark).schema))
    got = result(scan_licenses(docs), *COLUMNS)
    want = sorted(((r[0], *plain_row(r[1] if r[0] not in (5, 9, 109) else "", TEMPLATES)) for r in edge_rows() + rows), key=key)
    fix = {5: (5, 40_000, 0, None, None, "", "", 0.0), 9: (9, 1, 0, None, None, "", "", 0.0), 109: (109, 6000, 3000, 0, 5998, "mit", "mit", 1.0)}
    assert got == sorted((fix.get(w[0], w) for w in want), key=key)
    by = {g[0]: g for g in got}
    assert by[105][6] == "mit" and 0.8 <= by[105][7] < 1 and by[106][6] == "" and by[107][6] == "bsd,mit"
    assert by[108][6] == "cc-by,cc-by-nc"


def test_random_texts_over_few_words(spark):
    from ferrule.llm.licenses import Template, scan_licenses

    r = random.Random(3)
    voc = list("abcdef")
    templates = [Template("one", "a b", 1.0, True, 2), Template("two", "a b a b c", 1.0, True, 2), Template("three", "a b c d e f a c e", 0.6, False, 3),
                 Template("word", "f", 1.0, True, 2)]
    rows = [(i, " ".join(r.choice(voc) for _ in range(r.randint(0, 60)))) for i in range(300)]
    got = result(scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string"), templates), *COLUMNS)
    assert got == [(i, *plain_row(t, templates)) for i, t in rows]


def test_no_rows_and_a_text_id(spark):
    from ferrule.llm.licenses import license_spans, scan_licenses

    assert scan_licenses(no_docs(spark)).count() == 0
    got = license_spans(spark.createDataFrame([("a", "the MIT license")], "name string, body string"), id_col="name", text_col="body").collect()
    assert [(g.doc_id, g.label, g.first_word, g.end_word, g.score) for g in got] == [("a", "mit", 1, 3, 1.0)]


def test_main_path_has_no_python(spark):
    from ferrule.llm.licenses import scan_licenses

    plan = scan_licenses(edge_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("bound", [0, 100_000])
def test_large_template_tables_are_not_broadcast_by_hint(spark, monkeypatch, bound):
    from ferrule.llm import licenses

    monkeypatch.setattr(licenses, "BROADCAST_GRAMS", bound)
    docs = spark.createDataFrame([(1, "the MIT license"), (2, "none")], "doc_id bigint, text string")
    assert result(licenses.scan_licenses(docs), "doc_id", "labels") == [(1, "mit"), (2, "")]
