"""Queries: scalar text, date, log, HTML and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from ..functions.json import json_annotate
from ..functions.logs import log_markup, parse_log
from ..operators.misc import known_users, label, sentinel
from ..operators.prompt import attribute_list, customer_phrase, flatten_listing, public_view
from ..operators.spread import spread
from ..operators.vectors import exclude_value
from ..session import table
from .q_changes import log_lines
from .registry import query
from .sqlparts import PY_NON_WS, PY_WS, strip_sql, title_sql

AS_OF = "2025-06-30"  # the "today" of age computations (a parameter, never current_date)
SALT = "pepper-2025"
_UUID = "regexp_replace(md5({x}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


@query("md5_uuid", f"SELECT doc_id, {_UUID.format(x='doc_id::VARCHAR')} AS uuid FROM documents")
def md5_uuid(spark, d):
    """MD5 of the id in UUID layout."""
    return table(spark, d, "documents").select("doc_id", X.md5_uuid("doc_id").alias("uuid"))


@query("embed_input", "SELECT doc_id, doc_id::VARCHAR || ': ' || text AS embed_text FROM documents")
def embed_input(spark, d):
    """``id: description`` embedding input."""
    return table(spark, d, "documents").select("doc_id", X.embed_input("doc_id", "text").alias("embed_text"))


@query("title_case", f"""
    SELECT 'part' AS kind, p_partkey AS id, {title_sql('p_name')} AS title FROM part
    UNION ALL SELECT 'supplier', s_suppkey, {title_sql('s_name')} FROM supplier""")
def title_case(spark, d):
    """Python-style title case (after every non-letter), ``_``/``-`` -> space."""
    p = table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), X.title_case("p_name").alias("title"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), X.title_case("s_name").alias("title"))
    return p.unionByName(s)


@query("age_years", f"SELECT o_orderkey, datesub('year', o_orderdate::DATE, DATE '{AS_OF}')::INTEGER AS age FROM orders")
def age_years(spark, d):
    """Whole years from o_orderdate (standing for a birth date) to a fixed day."""
    return table(spark, d, "orders").select("o_orderkey", X.age_years(F.to_date("o_orderdate"), F.lit(AS_OF).cast("date")).alias("age"))


@query("epoch_day_format", """
    SELECT o_orderkey, (o_orderdate::DATE - DATE '1970-01-01')::INTEGER AS epoch_day,
           strftime(DATE '1970-01-01' + (o_orderdate::DATE - DATE '1970-01-01')::INTEGER, '%Y/%m/%d') AS dob FROM orders""")
def epoch_day_format(spark, d):
    """Days since epoch (as a change row carries a date) -> ``yyyy/MM/dd``."""
    o = table(spark, d, "orders").select("o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("epoch_day"))
    return o.withColumn("dob", X.epoch_day_format("epoch_day"))


@query("message_id", "SELECT event_id, epoch_us(ts) // 1000 AS mid FROM events")
def message_id(spark, d):
    """Message id = epoch millis, truncated."""
    e = table(spark, d, "events")
    return e.select("event_id", X.message_id("ts", e.schema["ts"].dataType).alias("mid"))


@query("customer_phrase", f"""
    SELECT o.o_orderkey, chr(10) || 'We have a new customer. Their name is ' || c.c_name || ', ' ||
           coalesce('is ' || datesub('year', try_strptime(dob, '%Y/%m/%d')::DATE, DATE '{AS_OF}')::VARCHAR || ' years old', 'was born in ' || dob) ||
           ' and is allergic to ' || coalesce(nullif(CASE WHEN o.o_orderkey % 3 = 0 THEN '' ELSE c.c_mktsegment END, ''), 'nothing') AS phrase
    FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'spring of ' || year(o_orderdate)::VARCHAR ELSE strftime(o_orderdate, '%Y/%m/%d') END AS dob FROM orders) o
    JOIN customer c ON c.c_custkey = o.o_custkey""")
def customer_phrase_q(spark, d):
    """New-customer sentence (age, or the raw date when it does not parse)."""
    dob = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("spring of "), F.year("o_orderdate").cast("string"))).otherwise(
        F.date_format("o_orderdate", "yyyy/MM/dd"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", dob.alias("dob"))
    c = table(spark, d, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).withColumn("allergies", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")))
    return j.select("o_orderkey", customer_phrase("c_name", "dob", "allergies", F.lit(AS_OF).cast("date")).alias("phrase"))


@query("clean_reply", f"""
    SELECT conv_id, turn, regexp_replace(replace({strip_sql('text')}, '>' || chr(10) || '<', '><'), '\\n+', '<br>', 'g') AS reply
    FROM conversations WHERE role = 'assistant'""")
def clean_reply(spark, d):
    """Reply clean-up for display."""
    c = table(spark, d, "conversations").where(F.col("role") == "assistant")
    return c.select("conv_id", "turn", X.clean_reply("text").alias("reply"))


@query("flatten_ws", """
    SELECT doc_id, regexp_replace(translate(replace(text, chr(13), ''), chr(10) || chr(9), '  '), ' +', ' ', 'g') AS flat FROM documents""")
def flatten_ws(spark, d):
    """Whitespace flattening of whole texts."""
    return spread(table(spark, d, "documents")).select("doc_id", X.flatten_ws("text").alias("flat"))


VARS = {"HOST": "db.internal", "PORT": "5432", "HOST_RO": "ro.db.internal"}


_NAME = "[\\p{L}\\p{N}_-]"


# documents with placeholders written into them, known and unknown ones
_VAR_SQL = "replace(replace(replace(text, ' the ', ' $ENV.HOST '), ' of ', ' $ENV.HOST_RO/$ENV.NONE$'), ' and ', ' $ENV. ')"


def _var_text():
    t = F.col("text")
    for a, b in ((" the ", " $ENV.HOST "), (" of ", " $ENV.HOST_RO/$ENV.NONE$"), (" and ", " $ENV. ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


@query("substitute_vars", f"""
    SELECT doc_id, array_to_string(list_transform(
             regexp_extract_all({_VAR_SQL}, '(\\$ENV\\.{_NAME}*|[^$]+|\\$)', 1),
             lambda p: CASE WHEN starts_with(p, '$ENV.') THEN
                 CASE substr(p, 6) WHEN 'HOST' THEN 'db.internal' WHEN 'PORT' THEN '5432'
                                   WHEN 'HOST_RO' THEN 'ro.db.internal' ELSE '' END
               ELSE p END), '') AS text_out FROM documents""")
def substitute_vars(spark, d):
    """``$ENV.NAME`` placeholders -> values in one pass, unknown -> ''."""
    return spread(table(spark, d, "documents")).select("doc_id", X.substitute_vars(_var_text(), VARS).alias("text_out"))


@query("placeholders", f"""
    SELECT doc_id, placeholder FROM (
      SELECT doc_id, unnest(list_distinct(regexp_extract_all({_VAR_SQL}, '\\$ENV\\.({_NAME}*)', 1))) AS placeholder FROM documents)""")
def placeholders(spark, d):
    """Distinct ``$ENV.NAME`` placeholders per text."""
    t = spread(table(spark, d, "documents")).select("doc_id", F.explode_outer(X.placeholders(_var_text())).alias("placeholder"))
    return t.where(F.col("placeholder").isNotNull())


@query("split_statements", f"""
    WITH f AS (SELECT doc_id, regexp_replace(translate(replace(text, chr(13), ''), chr(10) || chr(9), '  '), ' +', ' ', 'g') AS flat FROM documents),
    p AS (SELECT doc_id, list_filter(list_transform(string_split(flat, '.'), lambda s: {strip_sql('s')}), lambda s: s <> '') AS parts FROM f)
    SELECT doc_id, (generate_subscripts(parts, 1) - 1)::INTEGER AS pos, unnest(parts) || '.' AS stmt FROM p""")
def split_statements(spark, d):
    """Flatten whitespace, split sentences on '.', strip, drop empties."""
    t = spread(table(spark, d, "documents")).select("doc_id", X.split_statements(X.flatten_ws("text"), ".").alias("parts"))
    # outer explode: no size(parts) > 0 filter is inferred below the spread
    return t.select("doc_id", F.posexplode_outer("parts").alias("pos", "stmt")).where(F.col("stmt").isNotNull())


_LEVEL_SQL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'INFO' WHEN 'purchase' THEN 'WARNING' ELSE 'DEBUG' END"
_MSG_SQL = "'user ' || user_id::VARCHAR || ' value ' || value::VARCHAR"


@query("log_parse", f"""
    SELECT event_id, event_type AS app, {_LEVEL_SQL} AS level, {_MSG_SQL} AS message FROM events""")
def log_parse(spark, d):
    """Log line -> app, level, message."""
    return parse_log(log_lines(spark, d), "line").select("event_id", "app", "level", "message")


@query("log_markup", f"""
    SELECT event_id, '<div class=''log-' || event_type || '''><b>[' || event_type || ']</b> ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ','
           || strftime(ts, '%g') || '.' || strftime(ts, '%g') || ' <b>[' || {_LEVEL_SQL} || ']</b><br>' || {_MSG_SQL} || '</div>' AS html
    FROM events""")
def log_markup_q(spark, d):
    """Log line -> HTML row for the log page."""
    return log_lines(spark, d).select("event_id", log_markup(F.col("line")).alias("html"))


_FENCE_SQL = "CASE turn % 4 WHEN 0 THEN '```html' || text || '```' WHEN 1 THEN '`` `json' || text || '`` ` ' WHEN 2 THEN '```json' || text ELSE text END"


@query("strip_fences", f"""
    SELECT conv_id, turn, replace(replace(replace(replace(replace({_FENCE_SQL}, '`` `', '```'), '`` ` ', '```'), '```html', ''), '```json', ''), '```', '') AS text_out
    FROM conversations""")
def strip_fences(spark, d):
    """Markdown fence stripping (five ordered replacements)."""
    n, t = F.col("turn") % 4, F.col("text")
    fenced = (F.when(n == 0, F.concat(F.lit("```html"), t, F.lit("```"))).when(n == 1, F.concat(F.lit("`` `json"), t, F.lit("`` ` ")))
              .when(n == 2, F.concat(F.lit("```json"), t)).otherwise(t))
    return table(spark, d, "conversations").select("conv_id", "turn", H.strip_fences(fenced).alias("text_out"))


# the scan of the rewrites as a pattern without possessive repeats, and a text as its tokens
_SCAN_SQL = ("(?i)<!--[\\s\\S]*?-->|<script\\b[^>]*>[\\s\\S]*?</script\\s*>|<style\\b[^>]*>[\\s\\S]*?</style\\s*>|"
             "<[a-zA-Z/](?:[^\"''>]|\"[^\"]*\"|''[^'']*'')*>|[^<]+|<")


def _tags_sql(x, change):
    return f"array_to_string(list_transform(regexp_extract_all({x}, '{_SCAN_SQL}'), lambda t: {change}), '')"


_HEADINGS_SQL = _tags_sql("html", "regexp_replace(t, '(?i)^<(/?)h[1-5]([ \\t\\n\\f\\r>/])', '<\\1h6\\2')")


@query("html_headings", f"SELECT page_id, {_HEADINGS_SQL} AS html_out FROM pages")
def html_headings(spark, d):
    """h1..h5 -> h6."""
    return spread(table(spark, d, "pages")).select("page_id", H.html_headings("html").alias("html_out"))


def _set_class_sql(x, e, classes):
    ws = "[ \\t\\n\\f\\r]"
    attribute = f"[^ \\t\\n\\f\\r\"''>/=]+(?:{ws}*={ws}*(?:\"[^\"]*\"|''[^'']*''|[^ \\t\\n\\f\\r\"''>]+))?"
    rest = f"regexp_extract(t, '(?i)^<{e}([ \\t\\n\\f\\r>/][\\s\\S]*)$', 1)"
    own = (f"list_filter(regexp_extract_all(regexp_replace({rest}, '/?>$', ''), '{attribute}'), lambda a: NOT regexp_matches(a, '(?i)^class({ws}*=|$)'))")
    made = (f"'<' || regexp_extract(t, '(?i)^<({e})', 1) || ' class=\"{classes}\"' || array_to_string(list_transform({own}, lambda a: ' ' || a), '') "
            f"|| regexp_extract(t, '(/?>)$', 1)")
    return _tags_sql(x, f"CASE WHEN regexp_matches(t, '(?i)^<{e}[ \\t\\n\\f\\r>/]') THEN {made} ELSE t END")


_NAV_CLASSES = "nav nav-pills"
_P_CLASSES = "text-body small"


@query("html_set_class", f"""
    SELECT page_id, {_set_class_sql(_set_class_sql('h', 'nav', _NAV_CLASSES), 'p', _P_CLASSES)} AS html_out
    FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(replace(html, '<p>', '<p id=a class="x y">'), '<nav>', '<nav class=old>') ELSE html END AS h FROM pages)""")
def html_set_class(spark, d):
    """Set the class of every nav and p element (replacing an existing one)."""
    classed = F.replace(F.replace(F.col("html"), F.lit("<p>"), F.lit('<p id=a class="x y">')), F.lit("<nav>"), F.lit("<nav class=old>"))
    own = F.when(F.col("page_id") % 2 == 0, classed).otherwise(F.col("html"))
    h = H.html_set_class(H.html_set_class(own, "nav", _NAV_CLASSES), "p", _P_CLASSES)
    return spread(table(spark, d, "pages")).select("page_id", h.alias("html_out"))


@query("json_annotate", """
    SELECT event_id, json_object('k', json_extract(props, '$.k')::BIGINT,
                                 'status_code', CASE WHEN event_type = 'error' THEN 500 ELSE 200 END,
                                 'error', event_type = 'error')::VARCHAR AS annotated FROM events""")
def json_annotate_q(spark, d):
    """Add status_code/error fields to the JSON payload."""
    e = table(spark, d, "events")
    code = F.when(F.col("event_type") == "error", F.lit(500)).otherwise(F.lit(200))
    return e.select("event_id", json_annotate("props", [("k", "bigint")], code).alias("annotated"))


@query("json_annotate_all", """
    SELECT event_id, json_merge_patch(props, json_object('at', json_object('user', user_id), 'status_code', CASE WHEN event_type = 'error' THEN 500 ELSE 200 END,
                                                         'error', event_type = 'error'))::VARCHAR AS annotated FROM events""")
def json_annotate_all(spark, d):
    """The same for payloads of any fields, here with a nested one put in: all are kept."""
    e = table(spark, d, "events")
    code = F.when(F.col("event_type") == "error", F.lit(500)).otherwise(F.lit(200))
    more = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "at": {"user": '), F.col("user_id").cast("string"), F.lit('}, "error": "old"}'))
    return e.select("event_id", json_annotate(more, None, code).alias("annotated"))


@query("attribute_list", """
    SELECT p_partkey, 'P_Size ' || coalesce(p_size::VARCHAR, 'None') || ', P_Retailprice ' || coalesce(p_retailprice::VARCHAR, 'None') AS attrs FROM part""")
def attribute_list_q(spark, d):
    """``Key Value`` attribute list, excluded names left out, null -> None."""
    p = table(spark, d, "part")
    return p.select("p_partkey", attribute_list(["p_partkey", "p_name", "p_brand", "p_type"], p.columns).alias("attrs"))


@query("flatten_listing", """
    SELECT DISTINCT s_nationkey::VARCHAR AS category, NULL AS key, 0 AS depth, NULL AS field,
           '<h4 class=''text-warning mt-3''>' || s_nationkey::VARCHAR || '</h4>' AS line FROM supplier
    UNION ALL SELECT s_nationkey::VARCHAR, s_name, 1, NULL, '<h5 class=''text-info mt-1''>&emsp;' || s_name || '</h5>' FROM supplier
    UNION ALL SELECT s_nationkey::VARCHAR AS category, s_name AS key, 2 AS depth, field,
           '&emsp;&emsp;' || field || ':&nbsp;<span class=''text-muted''>' || value || '</span><br>' AS line
    FROM (SELECT s_nationkey, s_name, 's_suppkey' AS field, coalesce(s_suppkey::VARCHAR, 'None') AS value FROM supplier
          UNION ALL SELECT s_nationkey, s_name, 's_acctbal', coalesce(s_acctbal::VARCHAR, 'None') FROM supplier)""")
def flatten_listing_q(spark, d):
    """Nested listing (nation -> supplier -> fields) as indented rows."""
    return flatten_listing(table(spark, d, "supplier"), "s_nationkey", "s_name", ["s_suppkey", "s_acctbal"])


@query("salted_digest", f"SELECT c_custkey, sha256('{SALT}' || c_name) AS digest FROM customer")
def salted_digest(spark, d):
    """Salted SHA-256 masking of a column."""
    return table(spark, d, "customer").select("c_custkey", X.salted_digest("c_name", SALT).alias("digest"))


@query("templated_query", """
    SELECT section, 'Show me the ' || section || ' on the main menu' AS query,
           'Getting you the ' || replace(section, '_', ' ') || ' on the main menu...' AS wait
    FROM (SELECT DISTINCT lower(p_type) AS section FROM part)""")
def templated_query(spark, d):
    """Menu request text per section."""
    s = table(spark, d, "part").select(F.lower("p_type").alias("section")).distinct()
    return s.select("section", X.templated_query("section", "main").alias("query"), X.templated_wait("section", "main").alias("wait"))


@query("clock_text", "SELECT event_id, strftime(ts, '%H:%M:%S') AS clock FROM events")
def clock_text(spark, d):
    return table(spark, d, "events").select("event_id", X.clock_text("ts").alias("clock"))


@query("session_key", "SELECT event_id, md5(user_id::VARCHAR) AS session FROM events")
def session_key(spark, d):
    """Deterministic 32-hex session key per user."""
    return table(spark, d, "events").select("event_id", X.session_key("user_id").alias("session"))


_EMAIL = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"


@query("default_if_empty", f"""
    SELECT doc_id, coalesce(nullif(regexp_extract(text, '{_EMAIL}', 1), ''), 'nothing') AS contact FROM documents""")
def default_if_empty(spark, d):
    """Falsy default on the first e-mail found in a text."""
    t = spread(table(spark, d, "documents").select("doc_id", "text"))
    return t.select("doc_id", X.default_if_empty(X.first_match("text", _EMAIL), "nothing").alias("contact"))


@query("filter_must_not", "SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM 'src0'")
def filter_must_not(spark, d):
    """``must_not source = 'src0'``: rows without a source pass."""
    return exclude_value(table(spark, d, "documents").select("doc_id", "source"), "source", "src0")


@query("profile_view", """
    SELECT coalesce(nullif(c_custkey::VARCHAR, ''), 'N/A') AS c_custkey, coalesce(nullif(c_name, ''), 'N/A') AS c_name,
           coalesce(nullif(c_nationkey::VARCHAR, ''), 'N/A') AS c_nationkey, coalesce(nullif(c_mktsegment, ''), 'N/A') AS c_mktsegment
    FROM customer""")
def profile_view(spark, d):
    """Public projection: the secret column (balance) left out, falsy -> N/A."""
    c = table(spark, d, "customer")
    return public_view(c, c.columns, ["c_acctbal"])


_STATUS = {"F": "Fulfilled", "O": "Open"}


@query("code_label", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Fulfilled' WHEN 'O' THEN 'Open' ELSE 'Pending' END AS status_label FROM orders""")
def code_label(spark, d):
    """Code -> label with a default."""
    return table(spark, d, "orders").select("o_orderkey", label("o_orderstatus", _STATUS, "Pending").alias("status_label"))


@query("token_report", f"""
    SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN len(regexp_extract_all(coalesce(text, ''), '{PY_NON_WS}+'))::VARCHAR ELSE 'N/A' END AS tokens
    FROM conversations""")
def token_report(spark, d):
    """Tokens per reply; non-replies carry -1, shown as N/A."""
    c = table(spark, d, "conversations")
    tok = F.when(F.col("role") == "assistant", X.whitespace_tokens("text")).otherwise(F.lit(-1))
    return c.select("conv_id", "turn", sentinel(tok, -1, "N/A").alias("tokens"))


@query("known_user_gate", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def known_user_gate(spark, d):
    """Only actions of known users pass (semi join)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return known_users(o, table(spark, d, "customer").where(F.col("c_custkey") % 7 != 0), "o_custkey", "c_custkey")


@query("actions_enriched", f"""
    SELECT conv_id, turn, conv_id::VARCHAR AS key, text AS query, len(regexp_extract_all(coalesce(text, ''), '{PY_NON_WS}+')) AS n_tokens,
           md5(conv_id::VARCHAR) AS session
    FROM conversations WHERE role = 'user'""")
def actions_enriched(spark, d):
    """All columns of an action plus derived ones."""
    c = table(spark, d, "conversations").where(F.col("role") == "user")
    return c.select("conv_id", "turn", "text").withColumns(
        {"key": F.col("conv_id").cast("string"), "n_tokens": X.whitespace_tokens("text").cast("long"), "session": X.session_key("conv_id")}
    ).withColumnRenamed("text", "query")
