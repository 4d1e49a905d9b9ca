"""The thin queries of the operators: production parameters, whole tables, digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from .registry import query


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sp_codec import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


@query("op6_secrets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans")


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"), shingle=4, radius=4)


@query("op8_exact_dedup", sql=r"""
    with n as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
    g as (select doc_id, sha256(norm) as text_sha256,
                 first_value(doc_id) over (partition by norm order by length(t) desc, doc_id nulls first
                     rows between unbounded preceding and unbounded following) as keep_id,
                 count(*) over (partition by norm) as group_size from n)
    select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from g
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunk_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


@query("op1_decontamination", sql=r"""
    with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
    b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
    bw as (select item_id, least(len(w), 13) as l, unnest(generate_series(1, greatest(1, len(w) - 12))) as p, w from b where len(w) > 0),
    win as (select distinct item_id, l, array_to_string(w[p : p + l - 1], ' ') as t from bw),
    dw as (select doc_id, l, p, array_to_string(w[p : p + l - 1], ' ') as t
           from (select doc_id, w, l, unnest(generate_series(1, len(w) - l + 1)) as p from d, (select distinct l from win))),
    hit as (select doc_id, dw.l, p, item_id from dw join win on dw.l = win.l and dw.t = win.t),
    words as (select doc_id, count(distinct q) as n_hit from (select distinct doc_id, unnest(generate_series(p, p + l - 1)) as q from hit) group by doc_id),
    its as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as s
            from (select distinct doc_id, cast(item_id as varchar) as i from hit where item_id is not null) group by doc_id)
    select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256,
           coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
    from d left join words on words.doc_id = d.doc_id left join its on its.doc_id = d.doc_id
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op5_html_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_density import extract

    return extract(table(spark, sf_dir, "pages"))


@query("op9_substring_dedup", sql=r"""
    with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    win as (select doc_id, p, hash(array_to_string(w[p : p + 19], ' ')) as a, md5(array_to_string(w[p : p + 19], ' ')) as b
            from (select doc_id, w, unnest(generate_series(1, len(w) - 19)) as p from d)),
    late as (select doc_id, p from (select doc_id, p, row_number() over (partition by a, b order by doc_id, p) as k from win) where k > 1),
    gone as (select doc_id, list(distinct q) as qs from (select doc_id, unnest(generate_series(p, p + 19)) as q from late) group by doc_id),
    kept as (select doc_id, string_agg(x, ' ' order by q) as t
             from (select d.doc_id, unnest(w) as x, unnest(generate_series(1, len(w))) as q from d) e
             where not exists (select 1 from (select doc_id, unnest(qs) as q from gone) g where g.doc_id = e.doc_id and g.q = e.q) group by doc_id)
    select d.doc_id, len(w) as n_words, coalesce(len(qs), 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
    from d left join gone on gone.doc_id = d.doc_id left join kept on kept.doc_id = d.doc_id
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .anchor_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


@query("op4_warc", sql=r"""
    with p as (select page_id, coalesce(html, '') as h from pages),
    d as (select page_id, strlen(h) as n, sha1(h) as x, max(page_id) over (partition by h) as first from p)
    select page_id, n as payload_bytes,
           list_aggregate(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               cast((cast('0x' || substr(x, 10 * (i // 8) + 1, 10) as bigint) >> (35 - 5 * (i % 8))) & 31 as bigint) + 1, 1)), 'string_agg', '') as payload_digest,
           case when page_id = first then 'response' else 'revisit' end as record_type,
           case when page_id = first then null else first end as refers_to
    from d
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_index

    return archive_index(table(spark, sf_dir, "pages"), least=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _license_sql() -> str:
    """The twin of ``scan_licenses``, with the templates as rows."""
    from .licenses import SLACK, TEMPLATES

    rows = ", ".join(f"({n}, '{t.label}', {str(t.base).lower()}, {min(t.k, t.size)}, {t.least}, '{t.words}')" for n, t in enumerate(TEMPLATES))
    return rf"""
    with d as (select doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
    t as (select *, string_split(words, ' ') as tw from (values {rows}) v(template, label, base, k, least, words)),
    tg as (select t.*, q, array_to_string(tw[q + 1 : q + k], ' ') as gram from (select *, unnest(generate_series(0, len(tw) - k)) as q from t) t),
    dg as (select doc_id, text, k, p, array_to_string(w[p + 1 : p + k], ' ') as gram
           from (select doc_id, text, k, w, unnest(generate_series(0, len(w) - k)) as p from (select distinct doc_id, text, w from d), (select distinct k from t))),
    hit as (select doc_id, text, template, label, base, least, tg.k, len(tw) as size, q, p from dg join tg on dg.k = tg.k and dg.gram = tg.gram),
    di as (select doc_id, text, template, label, base, least, k, size, p - q as d, min(p) as f, list(distinct q) as qs
           from hit group by all),
    ne as (select *, coalesce(least >= 1 or d - lag(d) over x > {SLACK}, true) as fresh from di window x as (partition by doc_id, text, template order by d)),
    sp as (select *, sum(cast(fresh as int)) over (partition by doc_id, text, template order by d) as s from ne),
    got as (select doc_id, text, template, label, base, least, k, size, s, min(f) as f, flatten(list(qs)) as qs from sp group by all),
    ok as (select *, len(list_distinct(flatten(list_transform(qs, lambda q: generate_series(q, q + k - 1))))) / size as score from got),
    per as (select doc_id, text, count(*) filter (base) as n_base, min(f) filter (base) as first_word, max(f) filter (base) as last_word,
                   string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels,
                   max(score) as score
            from ok where score >= least group by doc_id, text)
    select d.doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
           coalesce(labels, '') as labels, cast(coalesce(score, 0) as double) as score
    from d left join per on per.doc_id is not distinct from d.doc_id and per.text is not distinct from d.text
    """


@query("op12_licenses", sql=_license_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op13_collocations", sql=r"""
    with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
    w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
    g as (select lang, m, array_to_string(w[i : i + m - 1], ' ') as phrase
          from (select lang, w, m, unnest(generate_series(1, len(w) - m + 1)) as i from w, (values (1), (2), (3), (4)) v(m))),
    f as materialized (select lang, phrase, m, count(*) as f from g group by all),
    t as (select lang, sum(f) as n from f where m = 1 group by lang),
    c as materialized (select lang, phrase, m, f as a, string_split(phrase, ' ') as w from f where m > 1 and f >= 30),
    e as materialized (select lang, phrase, a, cut, array_to_string(w[1 : cut], ' ') as lp, array_to_string(w[cut + 1 : m], ' ') as rp
                       from (select *, unnest(generate_series(1, m - 1)) as cut from c)),
    s as (select e.lang, e.phrase, e.a, e.cut as k, x.f as l, y.f as r, (2000000::hugeint * e.a) // (x.f + y.f) as score
          from e join f x on x.lang = e.lang and x.phrase = e.lp join f y on y.lang = e.lang and y.phrase = e.rp),
    b as (select lang, phrase, a, l, r, score from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
    i as (select lang, a, array_to_string(w[s : s + z - 1], ' ') as phrase
          from (select *, unnest(generate_series(1, m - z + 1)) as s from (select *, unnest(generate_series(2, m - 1)) as z from c))),
    o as (select lang, phrase, max(a) as longer from i group by all),
    left_ as (select b.* from b left join o on o.lang = b.lang and o.phrase = b.phrase
              where longer is null or 100::hugeint * longer < 80::hugeint * a),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from left_)
    select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked join t using (lang) where rank <= 2000
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_align import align

    return align(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))
