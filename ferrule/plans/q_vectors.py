"""Queries: similarity search, vectors, embedding, retrieval context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.embed import model_results, with_counts, with_vector
from ..functions.json import json_vector
from ..functions.sql import register
from ..functions.vector import as_double, cosine
from ..operators import pivots, pq_index
from ..operators.quality import vector_contract as vector_rules, with_reasons
from ..operators.retrieve import first_in_epoch, rag_context
from ..operators.spread import materialize, spread
from ..operators.vectors import knn, knn_approx, label_vote, recall
from ..session import table
from ..sources.vector_store import delete_points, to_points, upsert_vectors
from .registry import query
from .sqlparts import cosine_sql, hashed_terms_sql, knn_embeddings_sql

DIM_EMB = 64  # embeddings.embedding length
DIM_TEXT = 384  # default text vector size


def _emb(spark, d):
    return table(spark, d, "embeddings")


def _loo(spark, d, k, min_score=None):
    e = _emb(spark, d)
    return knn(e, e, k=k, min_score=min_score, query_id="vec_id", id_col="vec_id", vec_col="embedding", exclude_self=True)


@query("knn_exact", knn_embeddings_sql(2).replace("SELECT qid, rank::INTEGER AS rank, id, score", "SELECT qid, rank::INTEGER AS rank, id, round(score, 6) AS score"))
def knn_exact(spark, d):
    """Every vector against all others (leave-one-out), cosine top-2."""
    return _loo(spark, d, 2).withColumn("score", F.round("score", 6))


@query("knn_threshold", knn_embeddings_sql(2, 0.3).replace("SELECT qid, rank::INTEGER AS rank, id, score", "SELECT qid, rank::INTEGER AS rank, id, round(score, 6) AS score"))
def knn_threshold(spark, d):
    """Top-2 with the inclusive minimum score 0.3."""
    return _loo(spark, d, 2, 0.3).withColumn("score", F.round("score", 6))


@query("cosine_pairs", f"""
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT a.vec_id, b.vec_id AS next_id, round({cosine_sql('a.v', 'b.v')}, 6) AS score
    FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, d):
    """Cosine of each vector with the next id (scalar H22 on an equi-join)."""
    e = _emb(spark, d)
    a = e.select("vec_id", F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("b"))
    return a.join(b, b.next_id == a.vec_id + 1).select("vec_id", "next_id", F.round(cosine("a", "b"), 6).alias("score"))


_VOTE_SQL = f"""
    WITH nb AS ({knn_embeddings_sql(5)}),
    v AS (SELECT n.qid, e.label AS nlabel, count(*) AS votes FROM nb n JOIN embeddings e ON e.vec_id = n.id GROUP BY ALL),
    w AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, nlabel) AS r FROM v)
    SELECT w.qid AS vec_id, e.label, w.nlabel AS predicted, w.votes FROM w JOIN embeddings e ON e.vec_id = w.qid WHERE r = 1"""


def _vote(spark, d):
    e = _emb(spark, d)
    nb = _loo(spark, d, 5)
    v = label_vote(nb, e, id_col="vec_id", label_col="label")
    return v.join(e.select(F.col("vec_id").alias("qid"), "label"), "qid").select(
        F.col("qid").alias("vec_id"), "label", "predicted", "votes"
    )


@query("knn_label_vote", _VOTE_SQL)
def knn_label_vote(spark, d):
    """kNN (k=5, leave-one-out) label vote per vector."""
    return _vote(spark, d)


@query("knn_hit_rate", f"""
    WITH v AS ({_VOTE_SQL})
    SELECT label, count(*) AS n, sum(CASE WHEN predicted = label THEN 1 ELSE 0 END)::BIGINT AS hits,
           round(sum(CASE WHEN predicted = label THEN 1 ELSE 0 END) / count(*), 6) AS hit_rate
    FROM v GROUP BY label""")
def knn_hit_rate(spark, d):
    """Per label: how often the kNN vote finds the right label."""
    v = _vote(spark, d)
    hit = F.when(F.col("predicted") == F.col("label"), 1).otherwise(0)
    return v.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit).cast("long").alias("hits"),
        F.round(F.sum(hit) / F.count(F.lit(1)), 6).alias("hit_rate"),
    )


@query("knn_approx_recall")
def knn_approx_recall(spark, d):
    """Banded-LSH top-2 vs exact top-2: recall over all vectors (rows-only)."""
    e = _emb(spark, d)
    kw = dict(query_id="vec_id", id_col="vec_id", vec_col="embedding", exclude_self=True)
    approx = knn_approx(e, e, dim=DIM_EMB, k=2, bands=24, bits=4, **kw)
    exact = knn(e, e, k=2, **kw)
    r = recall(approx, exact)
    return r.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("recall"), 4).alias("recall"))


def _asked(spark, d):
    """The searches: every row whose id is divisible by 50, against all rows."""
    return _emb(spark, d).where(F.col("vec_id") % 50 == 0)


_PRUNED_SQL = f"""
    SELECT qid, rank::INTEGER AS rank, id, round(score, 6) AS score FROM ({knn_embeddings_sql(5)}) WHERE qid % 50 = 0"""


@query("knn_pruned", _PRUNED_SQL)
def knn_pruned(spark, d):
    """Exact top-5 that visits only the cells whose angle bounds can still matter."""
    e = _emb(spark, d)
    index = pivots.build(e, pivots=64, id_col="vec_id", vec_col="embedding")
    hits, _ = pivots.search(index, _asked(spark, d), k=5, query_id="vec_id", vec_col="embedding", exclude_self=True)
    return hits.withColumn("score", F.round("score", 6))


@query("knn_index_recall")
def knn_index_recall(spark, d):
    """The trained index (cells, product-quantised residuals, exact scores of the best 5 %) against exact search."""
    e = _emb(spark, d)
    n = e.count()
    kw = dict(id_col="vec_id", vec_col="embedding")
    model = pq_index.train(e, cells=32, parts=16, **kw)
    found = pq_index.search(model, pq_index.build(model, e, **kw), e, _asked(spark, d), k=5, probes=28, rerank=max(50, n // 20), query_id="vec_id", exclude_self=True, **kw)
    exact = knn(_asked(spark, d), e, k=5, query_id="vec_id", exclude_self=True, **kw)
    r = recall(found, exact)
    return r.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("recall"), 4).alias("recall"))


@query("novelty_filter", f"""
    WITH h AS ({knn_embeddings_sql(2)}),
    s AS (SELECT h.*, e.label FROM h JOIN embeddings e ON e.vec_id = h.qid),
    f AS (SELECT *, row_number() OVER (PARTITION BY label, id ORDER BY qid, rank) AS r FROM s)
    SELECT qid, rank, id, round(score, 6) AS score FROM f WHERE r = 1""")
def novelty_filter(spark, d):
    """Top-2 hits; a hit already given earlier in the session (= the query's
    label, queries in id order) is skipped, with no refill."""
    e = _emb(spark, d)
    h = _loo(spark, d, 2).join(e.select(F.col("vec_id").alias("qid"), "label"), "qid")
    return first_in_epoch(h, ["label"], "id", ["qid", "rank"]).select(
        "qid", "rank", "id", F.round("score", 6).alias("score")
    )


@query("vector_upsert", f"""
    WITH s AS (SELECT vec_id AS id, 0 AS version, list_sum(embedding::DOUBLE[]) AS vsum FROM embeddings),
    t AS {hashed_terms_sql('documents', 'doc_id', 'text', DIM_EMB)},
    b AS (SELECT id, 1 AS version, sum(tf) / sqrt(sum(tf * tf)) AS vsum FROM t GROUP BY id),
    u AS (SELECT * FROM s UNION ALL SELECT * FROM b)
    SELECT id, version, round(vsum, 6) AS vsum
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS r FROM u) WHERE r = 1""")
def vector_upsert(spark, d):
    """Collection = embeddings (version 0); a batch of document vectors
    (hashed to the same size, version 1) is upserted: last write per id wins."""
    e = _emb(spark, d)
    state = e.select(F.col("vec_id").alias("id"), F.lit(0).alias("version"), as_double("embedding").alias("vector"))
    docs = table(spark, d, "documents")
    batch = with_vector(docs.select(F.col("doc_id").alias("id"), "text"), "text", DIM_EMB).where("vector is not null").select(
        "id", F.lit(1).alias("version"), "vector"
    )
    u = upsert_vectors(state, batch.select("id", "version", F.col("vector.val").alias("vector")), "id", ["version"])
    vsum = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return u.select("id", "version", F.round(vsum, 6).alias("vsum"))


@query("vector_delete", """
    SELECT vec_id, label FROM embeddings
    WHERE vec_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')""")
def vector_delete(spark, d):
    """Hard delete of the points whose id is in a delete list (users with an error)."""
    ids = table(spark, d, "events").where(F.col("event_type") == "error").select(F.col("user_id").alias("vec_id"))
    return delete_points(_emb(spark, d).select("vec_id", "label"), ids, "vec_id")


@query("vector_contract", f"""
    SELECT vec_id, len(embedding) AS dim,
           concat_ws(',', CASE WHEN embedding IS NULL THEN 'null_vector' END,
                          CASE WHEN embedding IS NULL OR len(embedding) <> {DIM_EMB} THEN 'wrong_dimension' END,
                          CASE WHEN embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL)) > 0 THEN 'null_element' END) AS reasons
    FROM (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 13 = 0 THEN embedding[1:10]
                              WHEN vec_id % 17 = 0 THEN list_append(embedding[1:{DIM_EMB - 1}], NULL) ELSE embedding END AS embedding FROM embeddings)""")
def vector_contract(spark, d):
    """Declared dimension and no null elements; reasons per row ('' = valid)."""
    v, i = F.col("embedding"), F.col("vec_id")
    broken = (F.when(i % 13 == 0, F.slice(v, 1, 10)).when(i % 17 == 0, F.array_append(F.slice(v, 1, DIM_EMB - 1), F.lit(None))).otherwise(v))
    e = _emb(spark, d).withColumn("embedding", F.when(i % 11 != 0, broken))
    r = with_reasons(e, vector_rules(F.col("embedding"), DIM_EMB))
    return r.select("vec_id", F.size("embedding").cast("long").alias("dim"), F.array_join("reasons", ",").alias("reasons"))


def _doc_counts(spark, d):
    """Term counts and norm of every document, inside the row."""
    c = with_counts(spread(table(spark, d, "documents").select("doc_id", "text")), "text", DIM_TEXT)
    return c.withColumn("norm", F.sqrt(F.aggregate("_tf", F.lit(0.0), lambda a, x: a + x * x)))


@query("embed_buckets", f"""
    WITH t AS {hashed_terms_sql('documents', 'doc_id', 'text', DIM_TEXT)}
    SELECT id AS doc_id, bucket, tf, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)), 6) AS weight FROM t""")
def embed_buckets(spark, d):
    """Hashing embedder: (doc, bucket) term counts and unit weights."""
    c = _doc_counts(spark, d)
    e = c.select("doc_id", "norm", F.explode(F.arrays_zip("_idx", "_tf")).alias("e"))
    return e.select("doc_id", F.col("e._idx").alias("bucket"), F.col("e._tf").cast("long").alias("tf"),
                    F.round(F.col("e._tf") / F.col("norm"), 6).alias("weight"))


@query("embed_norm", f"""
    WITH t AS {hashed_terms_sql('documents', 'doc_id', 'text', DIM_TEXT)}
    SELECT id AS doc_id, sum(tf)::BIGINT AS n_tokens, count(*) AS n_buckets, round(sqrt(sum(tf * tf)), 6) AS norm
    FROM t GROUP BY id""")
def embed_norm(spark, d):
    """Per document: tokens, non-empty buckets and the vector norm."""
    c = _doc_counts(spark, d).where(F.size("_idx") > 0)
    return c.select("doc_id", F.aggregate("_tf", F.lit(0.0), lambda a, x: a + x).cast("long").alias("n_tokens"),
                    F.size("_idx").cast("long").alias("n_buckets"), F.round("norm", 6).alias("norm"))


def toy_model():
    """A stand-in for a trained model: two numbers per text; it refuses some texts."""

    def encode(texts):
        if any(len(t) % 10 == 3 for t in texts):
            raise ValueError("cannot embed")
        return [[float(len(t)), float(t.count(" "))] for t in texts]

    return encode


@query("embed_results", """
    SELECT doc_id, CASE WHEN length(text) % 10 <> 3 THEN length(text)::DOUBLE END AS v0,
           CASE WHEN length(text) % 10 <> 3 THEN (length(text) - length(replace(text, ' ', '')))::DOUBLE END AS v1,
           CASE WHEN length(text) % 10 = 3 THEN 500 ELSE 200 END AS status_code, length(text) % 10 = 3 AS error,
           CASE WHEN length(text) % 10 = 3 THEN 'ValueError: cannot embed' END AS message FROM documents""")
def embed_results(spark, d):
    """A model embedder that fails on some texts: null vector, status, error flag and reason for those rows only."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    r = docs.select("doc_id", model_results(toy_model)(F.col("text")).alias("r"))
    return r.select("doc_id", F.get("r.vector", F.lit(0)).alias("v0"), F.get("r.vector", F.lit(1)).alias("v1"), "r.status_code", "r.error", "r.message")


@query("sql_vector_data", f"""
    WITH t AS {hashed_terms_sql('documents', 'doc_id', 'text', DIM_TEXT)},
    n AS (SELECT id, sum(tf) / sqrt(sum(tf * tf)) AS vsum FROM t GROUP BY id)
    SELECT doc_id, regexp_replace(md5(text), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS text_uuid,
           CASE WHEN text IS NULL THEN NULL ELSE {DIM_TEXT}::BIGINT END AS dim, CASE WHEN text IS NOT NULL THEN round(coalesce(vsum, 0), 6) END AS vsum,
           CASE WHEN text IS NOT NULL THEN 200 END AS status_code
    FROM documents LEFT JOIN n ON n.id = doc_id""")
def sql_vector_data(spark, d):
    """The registered SQL functions ``hash_md5`` and ``get_vector_data`` over every document."""
    register(spark, dim=DIM_TEXT)
    told = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.expr("hash_md5(text)").alias("text_uuid"), F.expr("get_vector_data(text)").alias("v"))
    told = told.withColumn("r", F.from_json("v", "vector_data array<double>, status_code int"))
    vsum = F.aggregate("r.vector_data", F.lit(0.0), lambda a, x: a + x)
    dim = F.when(F.col("r.vector_data").isNotNull(), F.size("r.vector_data").cast("long"))
    return told.select("doc_id", "text_uuid", dim.alias("dim"), F.round(vsum, 6).alias("vsum"), F.col("r.status_code").alias("status_code"))


@query("sql_hashed_terms", f"""
    SELECT id AS doc_id, bucket, tf FROM {hashed_terms_sql('documents', 'doc_id', 'text', DIM_TEXT)}""")
def sql_hashed_terms(spark, d):
    """The registered table function ``hashed_terms`` joined to every document."""
    register(spark, dim=DIM_TEXT)
    view = "ferrule_documents"
    spread(table(spark, d, "documents").select("doc_id", "text")).createOrReplaceTempView(view)
    return spark.sql(f"SELECT doc_id, bucket, tf FROM {view}, LATERAL hashed_terms(text, {DIM_TEXT})")


def _doc_changes(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))  # before the join: the scan may be one task
    lab = table(spark, d, "labels").select("doc_id", "toxic")
    op = F.when(F.col("toxic") == 1, F.lit("d")).otherwise(F.lit("c"))
    return docs.join(lab, "doc_id", "left").select("doc_id", "text", op.alias("op"))


_DOC_OP_SQL = """(SELECT d.doc_id, d.text, CASE WHEN l.toxic = 1 THEN 'd' ELSE 'c' END AS op
                  FROM documents d LEFT JOIN labels l USING (doc_id))"""
_UUID = "regexp_replace(md5({x}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


@query("vdb_record", f"""
    WITH c AS {_DOC_OP_SQL},
    p AS (SELECT 'knowledge' AS collection_name, {_UUID.format(x='doc_id::VARCHAR')} AS id,
                 CASE WHEN op = 'd' THEN '' ELSE doc_id::VARCHAR END AS title,
                 CASE WHEN op = 'd' THEN '' ELSE text END AS description,
                 CASE WHEN op = 'd' THEN '' ELSE doc_id::VARCHAR || ': ' || text END AS embed_text FROM c),
    t AS {hashed_terms_sql("(SELECT * FROM p WHERE embed_text <> '')", 'id', 'embed_text', DIM_TEXT)},
    n AS (SELECT id, count(*) AS n_buckets FROM t GROUP BY id)
    SELECT p.collection_name, p.id, p.title, p.description, p.embed_text, n.n_buckets FROM p LEFT JOIN n USING (id)""")
def vdb_record(spark, d):
    """Documents (toxic label = delete) -> collection points: uuid id, payload
    title/description (blank on delete), embedding of ``id: text``."""
    pts = to_points(_doc_changes(spark, d), "doc_id", "text", dim=DIM_TEXT)  # no shuffle beside the label join
    nb = F.when(F.col("vector").isNotNull(), F.size("vector.idx").cast("long"))
    return pts.select("collection_name", "id", "title", "description", "embed_text", nb.alias("n_buckets"))


@query("json_vector", f"""SELECT vec_id, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS vsum FROM embeddings""")
def json_vector_q(spark, d):
    """Vector -> JSON ``{{"vector_data": [...]}}`` -> parsed back to doubles."""
    e = _emb(spark, d)
    js = F.to_json(F.struct(as_double("embedding").alias("vector_data")))
    v = json_vector(js)
    return e.select("vec_id", F.size(v).cast("long").alias("dim"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("vsum"))


def turn_key(conv="conv_id", turn="turn"):
    """Key of a turn, whatever the size of its numbers."""
    return F.concat_ws(":", F.col(conv).cast("string"), F.col(turn).cast("string"))


def rag_inputs(spark, d):
    """Actions = user turns of conversations with their vectors; corpus = (id, title, vector) of the documents that
    are not deleted, stored once; texts = (id, description), joined to the final hits only."""
    conv = table(spark, d, "conversations").where(F.col("role") == "user")
    actions = materialize(with_vector(spread(conv.select(turn_key().alias("qid"), "conv_id", "turn", F.col("text").alias("query"))), "query", DIM_TEXT))
    docs = table(spark, d, "documents").select("doc_id", "text")
    gone = table(spark, d, "labels").where(F.col("toxic") == 1).select("doc_id")
    named = spread(docs).select(
        "doc_id", F.col("doc_id").cast("string").alias("title"),
        F.concat(F.col("doc_id").cast("string"), F.lit(": "), F.col("text")).alias("embed_text"))
    # embedded before the join, which then moves vectors and no texts
    live = with_vector(named, "embed_text", DIM_TEXT).drop("embed_text").join(gone, "doc_id", "left_anti")
    corpus = materialize(live.select(F.col("doc_id").alias("id"), "title", "vector"))
    return actions, corpus, docs.select(F.col("doc_id").alias("id"), F.col("text").alias("description"))


@query("rag_context", f"""
    WITH q AS (SELECT conv_id, turn, conv_id * 1000000 + turn AS qid, text FROM conversations WHERE role = 'user'),
    qt AS {hashed_terms_sql('q', 'qid', 'text', DIM_TEXT)},
    qn AS (SELECT id, sqrt(sum(tf * tf)) AS n FROM qt GROUP BY id),
    c AS {_DOC_OP_SQL},
    live AS (SELECT doc_id, doc_id::VARCHAR AS title, text FROM c WHERE op <> 'd'),
    dt AS {hashed_terms_sql('live', 'doc_id', "doc_id::VARCHAR || ': ' || text", DIM_TEXT)},
    dn AS (SELECT id, sqrt(sum(tf * tf)) AS n FROM dt GROUP BY id),
    s AS (SELECT qt.id AS qid, dt.id AS id, sum(qt.tf * dt.tf) AS dotp FROM qt JOIN dt ON qt.bucket = dt.bucket GROUP BY ALL),
    sc AS (SELECT s.qid, s.id, s.dotp / (qn.n * dn.n) AS score FROM s JOIN qn ON qn.id = s.qid JOIN dn ON dn.id = s.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sc),
    h AS (SELECT r.qid, r.rank, q.conv_id, q.turn, l.title, l.text FROM r JOIN q ON q.qid = r.qid JOIN live l ON l.doc_id = r.id
          WHERE r.rank <= 2 AND round(r.score, 9) >= 0.3),
    nv AS (SELECT *, row_number() OVER (PARTITION BY conv_id, title ORDER BY turn, rank) AS fr FROM h),
    b AS (SELECT qid, 'Additional restaurant policies:' || string_agg(chr(10) || '- ' || title || ': ' || text, '' ORDER BY rank) AS context,
                 count(*)::INTEGER AS n_items FROM nv WHERE fr = 1 GROUP BY qid)
    SELECT q.conv_id, q.turn, b.context, b.n_items FROM q LEFT JOIN b USING (qid)""")
def rag_context_q(spark, d):
    """Flagship: user turn -> top-2 documents (>= 0.3, blank titles excluded,
    no repeats within a conversation) -> context block."""
    actions, corpus, texts = rag_inputs(spark, d)
    out = rag_context(actions, corpus, k=2, min_score=0.3, session=["conv_id"], turn="turn", sparse_dim=DIM_TEXT, texts=texts)
    return out.select("conv_id", "turn", "context", "n_items")
