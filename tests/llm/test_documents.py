import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from .cases import CLASH, edge_docs, edge_rows, no_docs, words

sha = lambda b: hashlib.sha256(b).hexdigest()
key = lambda r: tuple((v is not None, v) for v in r)


def result(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)


# ---- 1 decontamination

def plain_hits(doc, items, width):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (doc or "").encode()))
    hit, found, longest = set(), set(), 0
    for i, t in items:
        x = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        n = min(width, len(x))
        for p in range(len(x) - n + 1 if x else 0):
            for q in range(len(w) - n + 1):
                if w[q:q + n] == x[p:p + n]:
                    hit.update(range(q, q + n))
                    found.add(i)
                    m = n
                    while p + m < len(x) and q + m < len(w) and x[p + m] == w[q + m]:
                        m += 1
                    longest = max(longest, m)
    found.discard(None)
    return len(w), len(hit), sorted(map(str, found)), longest


def test_suffix_search_equals_brute_force():
    from ferrule.llm import decontam as D

    r = random.Random(4)
    voc = [f"w{i}" for i in range(6)]
    for _ in range(150):
        items = [(str(i), " ".join(r.choice(voc[:4]) for _ in range(r.randint(0, 9)))) for i in range(r.randint(1, 6))]
        docs = [" ".join(r.choice(voc) for _ in range(r.randint(0, 60))) for _ in range(6)]
        width = r.choice([1, 3, 5, 7])
        block = D.windows_of([(i, t.encode()) for i, t in items], width)
        if not len(block.length):
            continue
        for d, (n, spans, wins, longest) in zip(docs, D.search([d.encode() for d in docs], block)):
            got = n, sum(e - s for s, e in spans), sorted({i for w in wins for i in block.items[w]}), longest
            assert got == plain_hits(d, items, width)


@pytest.mark.parametrize("block_bytes", [16 << 20, 200])
def test_contamination_edges(spark, block_bytes):
    from ferrule.llm.decontam import contamination, decontaminate

    base = words(1, 400).split()
    items = [(1, " ".join(base[10:40])), (2, " ".join(base[30:60]).upper()), (2, " ".join(base[30:60]).upper()), (3, "one"), (4, None),
             (5, "..."), (None, words(4, 50)), (10, " ".join(base[100:113]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = edge_docs(spark)
    got = result(contamination(docs, bench, block_bytes=block_bytes), "doc_id", "n_words", "n_hit", "items", "contaminated")
    want = []
    for r in edge_rows():
        n, hit, found, _ = plain_hits(r[1] if r[0] not in (5, 9) else "", items, 13)
        if r[0] == 5:
            n = 40_000
        if r[0] == 9:
            n = 1
        want.append((r[0], n, hit, found, hit > 0 and 20 * hit >= n))
    assert got == sorted(want, key=key)
    left = decontaminate(docs, bench, block_bytes=block_bytes)
    assert left.columns == docs.columns
    bad = {w[0] for w in want if w[4]}
    assert {r[0] for r in left.collect()} == {w[0] for w in want} - bad
    assert contamination(no_docs(spark), bench).count() == 0
    assert contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


# ---- 2 SentencePiece, 3 token counts

ODD = ["", " ", "  a  b ", "a" * 3000, " " * 700, "▁▁", "<s></s><unk><0x0A>", "⁇ x", "don't I'LL 'S", "<|endoftext|>a<|startoftext|>",
       "ΑΣ ΑΣΑ İ ǅ ½²", "漢字 가나 ا ب 😀😀", "\x00\x01\t\n\r", "é ﬁ Ⱥ", "a b　c"]


def odd_texts():
    r = random.Random(2)
    some = ["".join(r.choice("ab ▁\n\té漢가😀́\x00aaa   <s>01中ñ'") for _ in range(r.randint(1, 60))) for _ in range(1500)]
    wide = ["".join(chr(r.choice([r.randint(0, 0x52F), r.randint(160, 0x2FFF), r.randint(0x4E00, 0x9FFF), r.randint(0x1F300, 0x1F9FF)]))
                    for _ in range(40)) for _ in range(300)]
    return ODD + some + wide


def test_codec_equals_the_library():
    import public_tokenizers
    import sentencepiece

    from ferrule.llm.sp_codec import Codec

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), Codec(path)
    for t in odd_texts():
        ids = lib.encode(t)
        told = ",".join(map(str, ids))
        assert own.encode(t) == told
        assert own.decode(told) == lib.decode(ids).encode()
    r = random.Random(3)
    for _ in range(500):
        ids = [r.randint(0, 31999) if r.random() < 0.5 else r.randint(0, 260) for _ in range(8)]
        assert own.decode(",".join(map(str, ids))).decode() == lib.decode(ids)


def test_long_texts_go_piece_by_piece(monkeypatch):
    import public_tokenizers

    from ferrule.llm import langid, sp_codec, token_counts

    own = sp_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    count = token_counts.RankCounter(public_tokenizers.path("word_bpe_49k.json"))
    ts = odd_texts()
    want = [own.encode(t) for t in ts], count.counts(ts), langid.features(ts)
    monkeypatch.setattr(sp_codec, "PIECE", 7)
    monkeypatch.setattr(token_counts, "PIECE", 7)
    monkeypatch.setattr(langid, "PIECE", 50)
    got = [own.encode(t) for t in ts], count.counts(ts), langid.features(ts)
    assert got[:2] == want[:2] and all((a == b).all() for a, b in zip(got[2], want[2]))


def test_encode_edges(spark):
    import public_tokenizers
    import sentencepiece

    from ferrule.llm.sp_codec import encode_digests, encode_documents

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = edge_docs(spark)
    want = sorted(((r[0], lib.encode(r[1] or "")) for r in edge_rows()), key=key)
    assert result(encode_documents(docs, path), "doc_id", "ids") == want
    assert result(encode_digests(docs, path), "doc_id", "ids_sha256", "decoded_sha256") == sorted(
        ((i, sha(",".join(map(str, ids)).encode()), sha(lib.decode(ids).encode())) for i, ids in want), key=key)
    assert encode_documents(no_docs(spark), path).count() == 0


def test_counter_equals_the_library():
    import public_tokenizers

    from ferrule.llm.token_counts import RankCounter

    own = RankCounter(public_tokenizers.path("word_bpe_49k.json"))
    ts = odd_texts()
    want = [len(e.ids) for e in own.lib.encode_batch(ts, add_special_tokens=False)]
    assert own.all_at_once and own.counts(ts) == want
    own.known.clear()
    own.all_at_once = False
    assert own.counts(ts) == want


def test_count_edges(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from ferrule.llm.token_counts import count_tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    want = [(r[0], len((r[1] or "").encode()), n := len(lib.encode(r[1] or "", add_special_tokens=False).ids), n > 2048) for r in edge_rows()]
    assert result(count_tokens(edge_docs(spark), path), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=key)
    assert count_tokens(no_docs(spark), path).count() == 0


# ---- 6 secrets

def test_base_spans_follow_the_rule():
    from ferrule.llm.secrets import base_spans, spans_text

    def plain(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(
            r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
        return sorted(out)

    r = random.Random(8)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ": ", " = \"", "'", "abcdefabcdef0123", "AKIAABCDEFGHIJ0123", "AKIA",
             "x" * 11, "Zz9+/_.=-abcd", " ", "\n", "é", "ſecret=abcdefabcdefabcdef", "Key"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 9)))
        assert base_spans(t) == plain(t), t
    assert spans_text(base_spans("password=abcdef0123456789")) == "assign:0:25,hex:9:25"


def test_markov_spans(spark):
    from ferrule.llm.secrets import find_secrets

    plain = " ".join(words(k, 200) for k in range(3)) + " internationalization configuration_manager getElementsByClassName"
    rows = [(1, plain), (2, plain + " ghp_x8KdQ2mZr7TfLw0VbN3sYcJ1 end"), (3, None), (4, "password=Xk29fLq0ZtRw7")]
    got = {r.doc_id: r for r in find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert (got[1].n_markov, got[2].n_markov, got[3].spans, got[4].n_assign) == (0, 1, "", 1)
    s, e = map(int, got[2].spans.split(":")[1:])
    assert rows[1][1][s:e] == "ghp_x8KdQ2mZr7TfLw0VbN3sYcJ1"
    assert got[4].base in got[4].spans and got[4].base_sha256 == sha(got[4].base.encode())
    docs = edge_docs(spark)
    assert find_secrets(docs).count() == len(edge_rows())
    assert find_secrets(no_docs(spark)).count() == 0


def test_markov_scores_whole_and_short_runs(spark):
    from ferrule.llm.secrets import find_secrets

    plain = " ".join(words(k, 200) for k in range(3)) + " configuration getElements internationalization"
    keys = {1: "Xk29fLq0ZtRw", 2: "qZ7LwX0Kf3bVTr0123456789abcdefYcJ1sNbV8m", 3: "x8KdQ2mZr7AKIAABCDEFGHIJ0123", 4: "0123456789abcdef0", 5: "Xk29fLq0ZtR"}
    rows = [(i, f"{plain} {k} {plain}") for i, k in keys.items()] + [(6, "token=Xk29fLq0ZtRw7Yc")]
    got = {r.doc_id: r for r in find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    at = len(plain) + 1
    for i, k in keys.items():
        marked = f"markov:{at}:{at + len(k)}"
        # covered by a base span entirely, or shorter than an assigned value: no span
        assert got[i].n_markov == (i < 4) and (marked in got[i].spans.split(",")) == (i < 4), got[i].spans
    assert (got[2].n_hex, got[3].n_access, got[4].n_hex, got[6].n_assign, got[6].n_markov) == (1, 1, 1, 1, 0)


@pytest.mark.parametrize("size", [12, 13, 14, 15, 16, 24])
def test_markov_threshold_by_length(spark, size):
    from ferrule.llm.secrets import THRESHOLD, base_spans, drawn_strings, scores, train

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    ratio = train(docs)
    drawn = [x[:size] for x in drawn_strings(4000, seed=99) if len(x) >= size]
    assert (scores(ratio, drawn) > THRESHOLD).mean() >= 0.98
    plain = [w for r in docs.collect() if r.text and not base_spans(r.text) for w in re.findall(r"[A-Za-z0-9+/_=-]+", r.text) if len(w) == size]
    assert not plain or (scores(ratio, plain) > THRESHOLD).mean() <= 0.001


# ---- 7 SimHash

def plain_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def plain_components(fps, radius):
    low = list(range(len(fps)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= radius).tolist():
            a, b = sorted((find(i), find(j)))
            low[b] = a
    return [find(i) for i in range(len(f))]


def test_near_groups_edges(spark):
    from ferrule.llm.simhash import near_groups

    rows = edge_rows()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    fps = [plain_fingerprint(rows[i][1]) for i in order]
    comp = plain_components(fps, 4)
    want = [(rows[i][0], f"{f:016x}", rows[order[c]][0]) for i, f, c in zip(order, fps, comp)]
    assert result(near_groups(edge_docs(spark)), "doc_id", "fingerprint", "component_id") == sorted(want, key=key)
    assert near_groups(no_docs(spark)).count() == 0


@pytest.mark.parametrize("slice_size", [4_000_000, 30_000])
def test_ball_hashing_finds_every_link(spark, monkeypatch, slice_size):
    """Chains and balls of fingerprints at 0 to 7 bits, in whole slices and in halved ones."""
    from ferrule.llm import components, simhash

    monkeypatch.setattr(simhash, "SLICE", slice_size)
    r = random.Random(6)
    fps = set()
    for _ in range(40):
        f = r.getrandbits(64)
        for _ in range(r.randint(1, 8)):
            fps.add(f)
            for b in r.sample(range(64), r.randint(0, 7)):
                f ^= 1 << b
    fps = sorted(fps, key=lambda x: x - (1 << 64) if x >> 63 else x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    links = [tuple(x) for x in simhash.close_links(df, 4).collect()]
    low = list(range(len(fps)))
    at = {x: i for i, x in enumerate(signed)}
    find = lambda i: i if low[i] == i else find(low[i])
    for u, v in links:
        a, b = sorted((find(at[u]), find(at[v])))
        low[b] = a
    want = plain_components(fps, 4)
    assert [find(i) for i in range(len(fps))] == want
    star = {r.u: r.v for r in components.roots(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert [at[star.get(x, x)] for x in signed] == want


# ---- 8 exact dedup

def test_chunks_depend_on_content():
    from ferrule.llm.chunk_dedup import LEAST, MOST, chunks

    r = random.Random(5)
    a, b = (bytes(r.choices(range(33, 127), k=60_000)) for _ in range(2))
    one, two, three = chunks([a, b"xy" + a, a[:1000] + b + a[1000:]])
    assert b"".join(one) == a and b"".join(two) == b"xy" + a and all(len(c) <= MOST for c in one) and all(len(c) >= LEAST for c in one[:-1])
    assert len(set(one) & set(two)) > 0.8 * len(one) and len(set(one) & set(three)) > 0.7 * len(one)
    assert chunks([a, b"", a])[2] == chunks([a])[0] == one


def test_exact_groups_edges(spark, monkeypatch):
    from ferrule.llm import chunk_dedup
    from ferrule.llm.chunk_dedup import exact_groups

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    rows = edge_rows()
    want = []
    for r in rows:
        same = [x for x in rows if norm(x[1]) == norm(r[1])]
        keep = min(same, key=lambda x: (-len(x[1] or ""), x[0] is not None, x[0] or 0))[0]
        want.append((r[0], keep, len(same), r[0] == keep, sha(norm(r[1]).encode())))
    cols = "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    assert result(exact_groups(edge_docs(spark)), *cols) == sorted(want, key=key)
    assert exact_groups(no_docs(spark)).count() == 0


def test_a_shared_identifier_is_noticed(spark):
    """With a hash that gives every chunk one of few identifiers, verification fails."""
    from ferrule.llm import chunk_dedup as C

    store = C.chunk_store(edge_docs(spark))
    assert store.where("bytes != other").isEmpty()
    worse = store.withColumn("id", F.substring("id", 1, 0)).groupBy("id").agg(F.min("bytes").alias("bytes"), F.max("other").alias("other"))
    assert not worse.where("bytes != other").isEmpty()


# ---- 9 substring dedup

def plain_removal(rows, window):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    first, out = {}, []
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            at = (i is not None, i or 0, p)
            first[k] = min(first.get(k, at), at)
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p:p + window])] < (i is not None, i or 0, p):
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone).decode()))
    return sorted(out, key=key)


@pytest.mark.parametrize("window,size", [(20, 8 << 20), (20, 20_000), (5, 5_000), (1, 50_000)])
def test_remove_repeats(spark, window, size):
    from ferrule.llm.anchor_dedup import remove_repeats

    r = random.Random(window + size)
    rows = [(x[0], x[1]) for x in edge_rows()]
    passage = words(50, 60).split()
    for i in range(60):
        t = words(100 + i, r.randint(0, 60)).split()
        a = r.randint(0, 40)
        t[len(t) // 2:len(t) // 2] = passage[a:a + r.randint(15, 45)] * r.randint(1, 2)
        rows.append((100 + i, " ".join(t)))
    docs = spark.createDataFrame([(*x, "clash", "clash") for x in rows], "doc_id bigint, text string, chunk string, part string")
    got = remove_repeats(docs, window, chunk_bytes=size, part_entries=3000)
    assert result(got, "doc_id", "n_words", "n_removed", "kept") == plain_removal(rows, window)
    assert all(x.kept_sha256 == sha(x.kept.encode()) for x in got.collect())


@pytest.mark.parametrize("hot", [None, 7])
def test_a_hot_id_stands_in_several_chunks(spark, hot):
    from ferrule.llm.anchor_dedup import deal, remove_repeats

    r = random.Random(5)
    passage = words(51, 30)
    rows = [(i, f"{words(500 + i, r.randint(0, 30))} {passage} {words(600 + i, 20)}") for i in range(6, 60)]
    rows += [(hot, f"{words(700 + i % 40, r.choice([4, 4, 9]))} {passage} {words(800 + i % 3, 30)}") for i in range(80)]
    rows += [(hot, words(900, 40))] * 200 + [(hot, None)] * 100 + [(hot, "")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    dealt, chunks, total, shared = deal(docs, 2000)
    assert shared and chunks > 20 and dealt.agg(F.sum("n")).first()[0] == len(rows)
    assert dealt.where(F.col("doc_id").eqNullSafe(F.lit(hot))).select("chunk").distinct().count() > 10
    assert dealt.groupBy("chunk").agg(F.sum(F.octet_length("text")).alias("b")).agg(F.max("b")).first()[0] < total / 10
    got = remove_repeats(docs, 10, chunk_bytes=2000, part_entries=300)
    assert result(got, "doc_id", "n_words", "n_removed", "kept") == plain_removal(rows, 10)
    assert result(remove_repeats(docs, 10, keep_text=False), "doc_id", "n_words", "n_removed") == [x[:3] for x in plain_removal(rows, 10)]


def test_remove_repeats_empty(spark):
    from ferrule.llm.anchor_dedup import remove_repeats

    assert remove_repeats(no_docs(spark)).count() == 0


# ---- 10 language ID

def test_held_out_accuracy(spark):
    from ferrule.llm.langid import identify

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert 150 < len(held) < 400 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_temperature_calibrates():
    from ferrule.llm.langid import Model, fit_temperature

    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 4000)
    right = rng.random(4000) < 0.8
    logits = np.zeros((4000, 2))
    logits[np.arange(4000), np.where(right, y, 1 - y)] = 20.0  # much too sure
    m = Model(["a", "b"], np.zeros((1, 2)), np.zeros(2), np.zeros(1))
    m.temperature = fit_temperature(m, logits, y)
    assert abs(m.probabilities(logits).max(1).mean() - 0.8) < 0.03


def test_language_edges(spark):
    from ferrule.llm.langid import identify, keep_identified

    docs = edge_docs(spark)
    got = {r.doc_id: r for r in identify(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 14))
    assert got[1].lang_pred != "und" and identify(docs).count() == len(edge_rows())
    left = keep_identified(docs, 0.0)
    assert left.columns == docs.columns and left.count() == len(edge_rows()) - 4 and set(left.columns) > set(CLASH)
    assert identify(no_docs(spark)).count() == 0
    assert {r.lang_pred for r in identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def many_languages(spark, n, each=30):
    rng = random.Random(n)
    rows = []
    for k in range(n):
        letters = [chr(0x61 + (k * 5 + j) % 26) for j in range(6)] + [chr(0x100 + k)]
        for i in range(each):
            t = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(20))
            rows.append((k * each + i, t, f"l{k:03d}"))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


@pytest.mark.parametrize("n", [2, 20, 300])
def test_every_language_can_be_predicted(spark, n):
    from ferrule.llm.langid import identify, keep_identified, least_score

    docs = many_languages(spark, n, 30 if n < 300 else 12)
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len({r.lang_pred for r in got}) == n
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    assert 1 / n < least_score(n) < 1
    if n < 300:  # clean texts stay, whatever the number of languages
        assert keep_identified(docs).count() >= 0.95 * docs.count()


def test_language_sample_rows(spark):
    from ferrule.llm import langid as G

    rows = [(None, f"null id number {i}", "a") for i in range(10)] + [(7, "one hot id", "a")] * 500 + [(i, words(i, 50), "b") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = G.sample(docs, 2, 30, 10, 1 << 20).collect()
    assert sum(r.text == "one hot id" for r in got) == 1 and sum(r.text.startswith("null id") for r in got) == 10
    assert sum(r.lang == "b" for r in got) == 21
    few = G.sample(docs, 2, 30, 10, 1000).collect()  # half of the characters for each language, but at least a row
    assert 1 <= sum(r.lang == "b" for r in few) <= 4
    assert sorted(got) == sorted(G.sample(docs.repartition(5), 2, 30, 10, 1 << 20).collect())
    only_null = spark.createDataFrame([(None, f"text {i}", "a") for i in range(5)], docs.schema)
    assert {r.lang_pred for r in G.identify(only_null).collect()} == {"a"}


def test_the_most_frequent_languages_are_learned(spark):
    from ferrule.llm.langid import train

    docs = many_languages(spark, 5).where("lang <> 'l002' or doc_id % 3 = 0")
    assert train(docs, languages=4).languages == ["l000", "l001", "l003", "l004"]
