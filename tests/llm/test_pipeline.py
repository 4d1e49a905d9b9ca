import importlib
import zlib

import duckdb
import pytest

import corpus_pipeline

from .cases import edge_docs, no_docs

SF = "/root/testdata/sf0.001"


def registered():
    from ferrule.llm.registry import load_all

    return load_all()


def rows(table):
    return sorted((tuple(r) for r in table), key=repr)


def test_every_operator_has_a_query():
    q, _ = registered()
    assert sorted(int(n[2:].split("_")[0]) for n in q) == list(range(1, 14))
    entry = importlib.import_module("__spark_entry__")
    assert set(q) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registered()[1]))
def test_query_equals_sql(spark, name):
    q, sql = registered()
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = q[name](spark, SF)
    want = con.sql(sql[name])
    order = [want.columns.index(c) for c in df.columns]
    assert rows(df.collect()) == rows([tuple(r[i] for i in order) for r in want.fetchall()])


def test_pipeline_equals_a_plain_version(spark):
    """Every stage against a plain one on that stage's own input, on a small table."""
    from .test_documents import plain_components, plain_fingerprint, plain_hits
    import re

    import public_tokenizers
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["language_id"](spark, docs, SF)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r.doc_id for r in docs.collect() if r.text and any(map(str.isalpha, r.text))}
    text = {r.doc_id: r.text for r in docs.collect()}

    def best(same):
        return min(same, key=lambda i: (-len(text[i]), i))

    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", text[i]) for i in ids}
    groups = {}
    for i in ids:
        groups.setdefault(norm[i], []).append(i)
    ids = sorted(map(best, groups.values()))
    comp = plain_components([plain_fingerprint(text[i]) for i in ids], 4)
    ids = [i for k, i in enumerate(ids) if comp[k] == k]
    hits = {i: plain_hits(text[i], bench, 13) for i in ids}
    ids = [i for i in ids if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: lib.encode(text[i]) for i in ids}


def test_stages_on_edges(spark):
    docs = edge_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, SF)
        assert new.columns == docs.columns, name
        docs = spark.createDataFrame(new.collect(), docs.schema)
    left = docs.collect()
    assert len(left) == len({(r.doc_id, r.text) for r in left}) and {5, 9, 10, 11} <= {r.doc_id for r in left}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(left)
    empty = no_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_fold_rule(spark):
    from ferrule.llm.langid import in_fold

    got = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("out", in_fold()).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert not spark.sql("select cast(null as bigint) as doc_id").select(in_fold()).first()[0]
