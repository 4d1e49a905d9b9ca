"""SQL fragments shared by the DuckDB oracle queries."""

# events as a change log: op per event type
EVENT_OP = "CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END"

# epoch millis, truncated like Spark unix_millis
EPOCH_MS = "(epoch_us(ts) // 1000)"

# session mid: signup = 0, error = null, other = millis
EVENT_MID = f"CASE event_type WHEN 'signup' THEN 0::BIGINT WHEN 'error' THEN NULL ELSE {EPOCH_MS} END"

# Python-style title case of a text expression (letters after any non-letter upper)
def title_sql(x: str, spaces: bool = True) -> str:
    if spaces:
        x = f"replace(replace({x}, '_', ' '), '-', ' ')"
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({x}), '(\\p{{L}}+|[^\\p{{L}}]+)', 1), "
        f"lambda w: upper(w[1]) || w[2:]), '')"
    )


PY_WS = (
    r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
PY_NON_WS = PY_WS[0] + "^" + PY_WS[1:]


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_WS}+|{PY_WS}+$', '', 'g')"


def cosine_sql(a: str, b: str) -> str:
    return (
        f"list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0)"
    )


def hashed_terms_sql(src: str, id_expr: str, text_expr: str, dim: int) -> str:
    """(id, bucket, tf) of the hashing embedder."""
    return f"""
    (SELECT id, ((('0x' || substr(md5(tok), 1, 8))::UBIGINT) % {dim})::INTEGER AS bucket, count(*) AS tf
     FROM (SELECT {id_expr} AS id, unnest(regexp_extract_all(lower({text_expr}), '[a-z0-9]+')) AS tok FROM {src})
     GROUP BY ALL)"""


# leave-one-out cosine top-k over embeddings (rank on round(score, 9), then id)
def knn_embeddings_sql(k: int, min_score: float | None = None) -> str:
    thr = f"AND score >= {min_score} - 1e-12" if min_score is not None else ""
    return f"""
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    p AS (SELECT a.vec_id AS qid, b.vec_id AS id, {cosine_sql('a.v', 'b.v')} AS score
          FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank
          FROM p WHERE score IS NOT NULL)
    SELECT qid, rank::INTEGER AS rank, id, score FROM r WHERE rank <= {k} {thr}"""
