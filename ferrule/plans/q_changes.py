"""Queries: change logs, state folds, sources/sinks, data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.json import payload_kind
from ..functions.logs import format_log
from ..operators.cdc import (
    change_audit,
    compact,
    current_state,
    orphan_deletes,
    retain,
    state_order,
    unwrap_changes,
)
from ..operators.misc import categorise
from ..operators.scan import grouped_scan
from ..operators.quality import duplicate_keys, quarantine
from ..session import scratch_path, table
from ..sources.changes import event_op, events_as_changes, read_many, since
from ..sources.seed import insert_new
from ..sources.sinks import delivery_report, keyed_order, log_filter, to_json_records, write_reported
from .registry import query
from .sqlparts import EVENT_OP

SEQ = ["ts", "event_id"]


def _ev(spark, d):
    return table(spark, d, "events")


def _changes(spark, d):
    """Unwrapped change rows: (event_id, ts, op, user_id, value, props)."""
    env = events_as_changes(_ev(spark, d))
    u = unwrap_changes(env, key="id", mode="sql", keep=["event_id", "ts"])
    return u.withColumnRenamed("id", "user_id").drop("bad")


_CH = f"(SELECT event_id, ts, {EVENT_OP} AS op, user_id, value, props FROM events)"


@query("cdc_read", f"SELECT event_id, {EVENT_OP} AS op, user_id AS key, ts FROM events")
def cdc_read(spark, d):
    """Change envelope over events (c = signup, d = error, u = others)."""
    env = events_as_changes(_ev(spark, d))
    return env.select("event_id", "op", F.coalesce("after.id", "before.id").alias("key"), "ts")


@query("cdc_unwrap", f"SELECT event_id, {EVENT_OP} AS op, user_id AS id, value, props FROM events")
def cdc_unwrap(spark, d):
    """Envelope unwrap (sql mode): delete -> before, else after; key out of the payload."""
    env = events_as_changes(_ev(spark, d))
    return unwrap_changes(env, key="id", mode="sql", keep=["event_id"]).drop("bad")


@query("cdc_current_state", f"""
    SELECT user_id, op, value, props, ts, event_id FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {_CH})
    WHERE r = 1 AND op <> 'd'""")
def cdc_current_state(spark, d):
    """Fold the change log to current state; deletes remove the key (hard)."""
    return current_state(_changes(spark, d), "user_id", SEQ, deletes="hard", payload=["value", "props"])


@query("cdc_soft_delete", f"""
    SELECT user_id, op, CASE WHEN op = 'd' THEN NULL ELSE value END AS value,
           CASE WHEN op = 'd' THEN '' ELSE props END AS props, ts, event_id, op = 'd' AS deleted FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {_CH})
    WHERE r = 1""")
def cdc_soft_delete(spark, d):
    """Soft delete: the key stays, payload blanked, ``deleted`` flag."""
    return current_state(_changes(spark, d), "user_id", SEQ, deletes="soft", payload=["value", "props"])


@query("cdc_state_order", f"""
    WITH c AS {_CH},
    ld AS (SELECT user_id, max(ts) AS ld_ts FROM c WHERE op = 'd' GROUP BY user_id),
    a AS (SELECT c.* FROM c LEFT JOIN ld USING (user_id) WHERE ld.ld_ts IS NULL OR c.ts > ld.ld_ts),
    l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM a),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM a)
    SELECT l.user_id, l.op, l.value, l.props, l.ts, l.event_id, f.ts AS first_ts, f.event_id AS first_event_id
    FROM l JOIN f ON f.user_id = l.user_id AND f.r = 1 WHERE l.r = 1""")
def cdc_state_order(spark, d):
    """Live state with its place: first write since the last delete."""
    return state_order(_changes(spark, d), "user_id", SEQ, payload=["value", "props"])


@query("compact_log", """
    SELECT user_id, event_id, ts, event_type, value, props FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def compact_log(spark, d):
    """Compaction: latest row per key, tombstones kept."""
    return compact(_ev(spark, d), "user_id", SEQ)


@query("retain_recent", """
    SELECT event_id, user_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def retain_recent(spark, d):
    """Delete policy: keep the last 7 days relative to the newest row."""
    return retain(_ev(spark, d), "ts", "7 DAYS").select("event_id", "user_id", "ts")


@query("orphan_deletes", f"""
    WITH c AS {_CH},
    g AS (SELECT user_id,
                 min(CASE WHEN op IN ('c', 'u', 'r') THEN ts END) AS w_ts,
                 arg_min(CASE WHEN op = 'd' THEN event_id END, CASE WHEN op = 'd' THEN ts END) AS d_id,
                 min(CASE WHEN op = 'd' THEN ts END) AS d_ts FROM c GROUP BY user_id)
    SELECT user_id, d_ts AS first_delete_ts, d_id AS first_delete_event_id FROM g
    WHERE d_ts IS NOT NULL AND (w_ts IS NULL OR d_ts < w_ts)""")
def orphan_deletes_q(spark, d):
    """Keys deleted before they were ever inserted."""
    return orphan_deletes(_changes(spark, d), "user_id", SEQ)


@query("change_audit", f"""
    SELECT event_id, CASE WHEN op = 'd' THEN 'Deleted events for ' || user_id::VARCHAR
           ELSE 'Upserted events for ' || user_id::VARCHAR || ': ' || json_object('value', value, 'props', p)::VARCHAR END AS audit
    FROM (SELECT *, CASE WHEN event_id % 4 <> 0 THEN props END AS p FROM {_CH})""")
def change_audit_q(spark, d):
    """Audit line per change of a keyed item table (a null field stays in the payload)."""
    c = _changes(spark, d).withColumn("props", F.when(F.col("event_id") % 4 != 0, F.col("props")))
    return change_audit(c, "events", "user_id", ["value", "props"]).select("event_id", "audit")


@query("change_audit_text", f"""
    SELECT event_id, CASE WHEN op = 'd' THEN 'Deleted policies for ' || user_id::VARCHAR
           ELSE 'Loaded policies for ' || user_id::VARCHAR || ': ' || coalesce(props, 'None') END AS audit FROM {_CH}""")
def change_audit_text(spark, d):
    """Audit line per change of a text table: the description alone."""
    return change_audit(_changes(spark, d), "policies", "user_id", "props").select("event_id", "audit")


@query("write_report", "SELECT 'events' AS name, 'ok' AS status, count(*) AS rows, min(event_id) AS min_key, max(event_id) AS max_key, NULL::VARCHAR AS message FROM events")
def write_report(spark, d):
    """What a write reports about itself: rows and key range observed while writing."""
    r = write_reported(_ev(spark, d), scratch_path(spark, "write_report"), "events", "event_id")
    return spark.createDataFrame([tuple(r.values())], "name string, status string, rows bigint, min_key bigint, max_key bigint, message string")


@query("write_metrics", f"""
    SELECT op, count(*) AS n_rows, min(user_id) AS min_key, max(user_id) AS max_key FROM {_CH} GROUP BY op""")
def write_metrics(spark, d):
    """Delivery report per op: rows written and key range."""
    return delivery_report(_changes(spark, d), "op", "user_id")


@query("rekey_stream", "SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events")
def rekey_stream(spark, d):
    """Keyed sink layout: rows of a key in one partition, in log order."""
    laid = keyed_order(_ev(spark, d).select("user_id", "event_id", "ts"), "user_id", SEQ)
    return grouped_scan(laid, ["user_id"], SEQ, number="pos")


@query("start_latest", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def start_latest(spark, d):
    """Start position: only rows after a timestamp lower bound."""
    return since(_ev(spark, d), "ts", "2024-01-15 00:00:00").select("event_id", "ts")


@query("route_payload", """
    SELECT 'events' AS source, event_id AS id,
           CASE WHEN props IS NULL THEN 'tombstone' WHEN json_valid(props) AND ltrim(props) LIKE '{%' THEN 'json' ELSE 'text' END AS kind
    FROM events
    UNION ALL
    SELECT 'documents', doc_id,
           CASE WHEN text IS NULL THEN 'tombstone' WHEN json_valid(text) AND ltrim(text) LIKE '{%' THEN 'json' ELSE 'text' END
    FROM documents""")
def route_payload_q(spark, d):
    """Payload router: null -> tombstone, JSON object -> json, else text."""
    e = _ev(spark, d).select(F.lit("events").alias("source"), F.col("event_id").alias("id"), payload_kind("props").alias("kind"))
    t = table(spark, d, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), payload_kind("text").alias("kind"))
    return e.unionByName(t)


@query("json_record", """
    SELECT json_object('c_custkey', c_custkey, 'c_name', c_name, 'c_nationkey', nullif(c_nationkey, 3),
                       'c_acctbal', c_acctbal, 'c_mktsegment', c_mktsegment)::VARCHAR AS value FROM customer""")
def json_record(spark, d):
    """Schemaless JSON record per row."""
    c = table(spark, d, "customer")
    return to_json_records(c.withColumn("c_nationkey", F.nullif("c_nationkey", F.lit(3))))


_LEVEL_SQL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'INFO' WHEN 'purchase' THEN 'WARNING' ELSE 'DEBUG' END"
_LOG_SQL = (
    "'[' || event_type || '] ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || strftime(ts, '%g') || '.' || strftime(ts, '%g')"
    f" || ' [' || {_LEVEL_SQL} || ']: user ' || user_id::VARCHAR || ' value ' || value::VARCHAR"
)


def log_lines(spark, d):
    """Log lines rendered from events (app = event type)."""
    e = _ev(spark, d)
    t = F.col("event_type")
    level = (F.when(t == "error", "ERROR").when(t == "signup", "INFO").when(t == "purchase", "WARNING").otherwise("DEBUG"))
    msg = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" value "), F.col("value").cast("string"))
    return e.select("event_id", level.alias("level"), format_log(t, F.col("ts"), level, msg).alias("line"))


@query("log_sink_filter", f"""SELECT event_id, {_LEVEL_SQL} AS level, {_LOG_SQL} AS line FROM events
    WHERE event_type IN ('error', 'signup', 'purchase')""")
def log_sink_filter(spark, d):
    """Application-log sink keeps INFO and above."""
    return log_filter(log_lines(spark, d), "level", "INFO")


@query("multi_source_union", """
    SELECT 'region' AS source, r_regionkey, r_name, NULL::INTEGER AS n_nationkey, NULL::VARCHAR AS n_name,
           NULL::INTEGER AS n_regionkey, NULL::BIGINT AS s_suppkey, NULL::VARCHAR AS s_name, NULL::INTEGER AS s_nationkey,
           NULL::DOUBLE AS s_acctbal FROM region
    UNION ALL SELECT 'nation', NULL, NULL, n_nationkey, n_name, n_regionkey, NULL, NULL, NULL, NULL FROM nation
    UNION ALL SELECT 'supplier', NULL, NULL, NULL, NULL, NULL, s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""")
def multi_source_union(spark, d):
    """Several sources as one, by column name, tagged with the source."""
    return read_many({n: table(spark, d, n) for n in ("region", "nation", "supplier")})


# -- fixed values: source -> category map with catch-all of the original -------
CATEGORIES = {"region": "ai_rules", "supplier": "policies"}
DEFAULT_CATEGORY = "restaurant"


@query("categorise_source", """
    SELECT source, name, CASE source WHEN 'region' THEN 'ai_rules' WHEN 'supplier' THEN 'policies' ELSE 'restaurant' END AS category
    FROM (SELECT 'region' AS source, r_name AS name FROM region UNION ALL SELECT 'nation', n_name FROM nation
          UNION ALL SELECT 'supplier', s_name FROM supplier)""")
def categorise_source(spark, d):
    """Source -> category with a catch-all."""
    u = multi_source_union(spark, d)
    return u.select("source", F.coalesce("r_name", "n_name", "s_name").alias("name"),
                    categorise("source", CATEGORIES, DEFAULT_CATEGORY).alias("category"))


@query("seed_insert_new", """
    SELECT r_regionkey, r_name FROM region
    UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)""")
def seed_insert_new(spark, d):
    """Idempotent insert: nations offered as regions, only new keys appended."""
    reg = table(spark, d, "region")
    batch = table(spark, d, "nation").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name"))
    return insert_new(reg, batch, ["r_regionkey"])


@query("quarantine", """
    SELECT event_id, reason FROM (
      SELECT event_id, unnest([CASE WHEN user_id IS NULL THEN 'null_key' END,
                               CASE WHEN props IS NULL OR NOT json_valid(props) THEN 'bad_json' END,
                               CASE WHEN value IS NULL OR value < 1 THEN 'low_value' END,
                               CASE WHEN event_type IS NULL OR event_type NOT IN ('signup', 'click', 'view', 'purchase', 'error') THEN 'unknown_op' END]) AS reason
      FROM events) WHERE reason IS NOT NULL""")
def quarantine_q(spark, d):
    """Row contract on the change log; one row per broken rule."""
    return quarantine(_ev(spark, d), ["event_id"], event_rules())


def event_rules() -> dict:
    """Row contract of the change log (a rule is true for a good row)."""
    return {
        "null_key": F.col("user_id").isNotNull(),
        "bad_json": F.try_parse_json("props").isNotNull(),
        "low_value": F.col("value") >= 1,
        "unknown_op": F.col("event_type").isin("signup", "click", "view", "purchase", "error"),
    }


@query("duplicate_keys", """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1
    UNION ALL
    SELECT doc_id, NULL, count(*) FROM documents GROUP BY doc_id HAVING count(*) > 1""")
def duplicate_keys_q(spark, d):
    """Primary-key checks: lineitem (order, line) and documents (doc_id)."""
    li = duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])
    dc = duplicate_keys(table(spark, d, "documents"), ["doc_id"]).select(
        F.col("doc_id").alias("l_orderkey"), F.lit(None).cast("int").alias("l_linenumber"), "n"
    )
    return li.unionByName(dc)
