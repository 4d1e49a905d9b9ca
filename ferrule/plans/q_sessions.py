"""Queries: session state, conversation folds, correlation, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import PY_NON_WS, message_id, reply_key
from ..operators.misc import attach_context, ordered_steps, zip_pair
from ..operators.scan import grouped_scan
from ..operators.replies import correlate, purge_prefix, reply_cache
from ..operators.sessions import (  # noqa: F401
    ERROR_REPLY,
    TIMEOUT_REPLY,
    classify_action,
    history_chunks,
    orphan_turns,
    seen_titles,
    session_state,
    session_timeout,
    token_usage,
)
from ..session import table
from ..sources.changes import events_as_actions
from .registry import query
from .sqlparts import EVENT_MID

SEQ = ["ts", "event_id"]
_TIMEOUT = TIMEOUT_REPLY.replace("'", "''")  # as SQL literals
_ERROR = ERROR_REPLY.replace("'", "''")


def _actions(spark, d):
    return events_as_actions(table(spark, d, "events")).select("event_id", "user_id", "ts", "event_type", "mid")


def _state(spark, d):
    return session_state(_actions(spark, d), "user_id", SEQ, "ts")


_STATE_SQL = f"""
    a AS (SELECT event_id, user_id, ts, event_type, {EVENT_MID} AS mid FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM a),
    s AS (SELECT *, sum(CASE WHEN mid = 0 THEN 1 ELSE 0 END) OVER w AS epoch,
                 max(CASE WHEN mid = 0 THEN ts END) OVER w AS last_start_ts,
                 max(CASE WHEN mid = 0 THEN pos END) OVER w AS last_start,
                 max(CASE WHEN mid IS NULL THEN pos END) OVER w AS last_logout
          FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    st AS (SELECT *, (last_start IS NOT NULL AND (last_logout IS NULL OR last_start > last_logout)) AS started FROM s)"""


@query("classify_action", f"""
    SELECT event_id, user_id, {EVENT_MID} AS mid,
           CASE WHEN event_type = 'error' THEN 'logout' WHEN event_type = 'signup' THEN 'start' ELSE 'message' END AS action FROM events""")
def classify_action_q(spark, d):
    """Control split on mid: null = logout, 0 = start, else message."""
    return classify_action(_actions(spark, d)).select("event_id", "user_id", "mid", "action")


@query("session_epochs", f"""
    WITH {_STATE_SQL}
    SELECT event_id, user_id, mid, epoch::BIGINT AS epoch, started, last_start_ts FROM st""")
def session_epochs(spark, d):
    """Per action: epoch (starts so far), session open or not, last start."""
    return _state(spark, d).select("event_id", "user_id", "mid", "epoch", "started", "last_start_ts")


@query("orphan_turns", f"""
    WITH {_STATE_SQL}
    SELECT event_id, user_id, mid, '{_ERROR}' AS response, -1 AS total_tokens FROM st
    WHERE mid IS NOT NULL AND mid <> 0 AND NOT started""")
def orphan_turns_q(spark, d):
    """Messages to a session that never started (or logged out): error reply, tokens -1."""
    return orphan_turns(_state(spark, d)).select("event_id", "user_id", "mid", "response", "total_tokens")


@query("session_timeout", f"""
    WITH {_STATE_SQL}
    SELECT event_id, user_id, (epoch_us(ts) - epoch_us(last_start_ts)) / 1000000 AS session_age_s,
           CASE WHEN NOT started THEN 'orphan' WHEN epoch_us(ts) - epoch_us(last_start_ts) > 3600000000::BIGINT THEN 'expired' ELSE 'active' END AS status
    FROM st WHERE mid IS NOT NULL AND mid <> 0""")
def session_timeout_q(spark, d):
    """Login lasts one hour: each message is active, expired or orphan."""
    return session_timeout(_state(spark, d), "ts", 3600).select("event_id", "user_id", "session_age_s", "status")


@query("seen_titles", f"""
    WITH {_STATE_SQL}
    SELECT user_id, epoch, chunk, string_agg(event_type, ',' ORDER BY event_type) AS titles
    FROM (SELECT *, (row_number() OVER (PARTITION BY user_id, epoch ORDER BY event_type) - 1) // 2 AS chunk
          FROM (SELECT DISTINCT user_id, epoch::BIGINT AS epoch, event_type FROM st WHERE mid IS NOT NULL AND mid <> 0))
    GROUP BY ALL""")
def seen_titles_q(spark, d):
    """Distinct titles given per session epoch."""
    s = _state(spark, d).where(F.col("mid").isNotNull() & (F.col("mid") != 0))
    return seen_titles(s, ["user_id", "epoch"], "event_type", chunk=2)


@query("token_usage", f"""
    SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '{PY_NON_WS}+'))::BIGINT AS tokens,
           sum(len(regexp_extract_all(coalesce(text, ''), '{PY_NON_WS}+'))) OVER (PARTITION BY conv_id ORDER BY turn
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS history_tokens
    FROM conversations""")
def token_usage_q(spark, d):
    """Tokens per turn and the running history size per conversation."""
    c = table(spark, d, "conversations")
    return token_usage(c, "conv_id", ["turn"], "text").select("conv_id", "turn", "tokens", "history_tokens")


@query("chat_history", """
    SELECT conv_id, (turn // 64)::BIGINT AS chunk, count(*) AS n_turns,
           string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history
    FROM conversations GROUP BY ALL""")
def chat_history(spark, d):
    """Ordered (role, text) history per conversation, folded in 64-turn chunks."""
    return history_chunks(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", 64)


@query("reply_cache", """
    SELECT reply_key, event_id, ts, value FROM (
      SELECT user_id::VARCHAR || ':' || event_type AS reply_key, event_id, ts, value,
             row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def reply_cache_q(spark, d):
    """Reply cache: last write per key wins."""
    e = table(spark, d, "events").select(reply_key("user_id", "event_type").alias("reply_key"), "event_id", "ts", "value")
    return reply_cache(e, "reply_key", SEQ)


@query("request_response", f"""
    WITH rq AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'),
    rs AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'),
    m AS (SELECT rq.user_id, rq.event_id, rq.ts, arg_min(rs.event_id, rs.ts) AS rid, min(rs.ts) AS rts
          FROM rq LEFT JOIN rs ON rs.user_id = rq.user_id AND rs.ts >= rq.ts AND rs.ts <= rq.ts + INTERVAL 7200 SECOND
          GROUP BY ALL)
    SELECT user_id, event_id, ts, rid AS resp_event_id, rts AS resp_ts, (epoch_us(rts) - epoch_us(ts)) // 1000 AS latency_ms,
           CASE WHEN rid IS NULL THEN 'timeout' ELSE 'matched' END AS status,
           CASE WHEN rid IS NULL THEN '{_TIMEOUT}' END AS reply FROM m""")
def request_response(spark, d):
    """Click -> first purchase of the same user within 2 h, else timeout."""
    e = table(spark, d, "events")
    rq = e.where(F.col("event_type") == "click").select("user_id", "event_id", "ts")
    rs = e.where(F.col("event_type") == "purchase").select("user_id", F.col("event_id").alias("resp_event_id"), F.col("ts").alias("resp_ts"))
    return correlate(rq, rs, ["user_id"], "event_id", "ts", "resp_event_id", "resp_ts", 7200)


@query("turn_pairs", """
    SELECT u.conv_id, u.turn, a.turn AS reply_turn, CASE WHEN a.turn IS NULL THEN 'timeout' ELSE 'matched' END AS status
    FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
    WHERE u.role = 'user'""")
def turn_pairs(spark, d):
    """User turn -> the assistant turn right after it, else timeout."""
    c = table(spark, d, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn")
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("reply_turn"))
    j = u.join(a, ["conv_id", "turn"], "left")
    return j.withColumn("status", F.when(F.col("reply_turn").isNull(), "timeout").otherwise("matched"))


@query("prefix_purge", f"""
    WITH c AS (SELECT user_id::VARCHAR || ':' || coalesce(({EVENT_MID})::VARCHAR, 'None') AS reply_key FROM events
               WHERE event_type NOT IN ('signup', 'error'))
    SELECT reply_key FROM c WHERE split_part(reply_key, ':', 1) NOT IN (SELECT user_id::VARCHAR FROM events WHERE event_type = 'error' AND user_id % 2 = 0)""")
def prefix_purge(spark, d):
    """Cached replies of sessions that logged out are purged by key prefix."""
    a = _actions(spark, d)
    cache = a.where(~F.col("event_type").isin("signup", "error")).select(reply_key("user_id", "mid").alias("reply_key"))
    gone = a.where((F.col("event_type") == "error") & (F.col("user_id") % 2 == 0)).select("user_id")
    return purge_prefix(cache, gone, "reply_key", "user_id", ":")


@query("prefix_purge_nested", """
    WITH k AS (SELECT o_orderkey, o_custkey::VARCHAR || ':' || replace(left(o_orderdate::VARCHAR, 10), '-', ':') AS reply_key FROM orders),
    s AS (SELECT DISTINCT user_id::VARCHAR || CASE WHEN event_type = 'error' THEN ':' ELSE ':1996' END AS session FROM events)
    SELECT o_orderkey, reply_key FROM k WHERE NOT EXISTS (SELECT 1 FROM s WHERE starts_with(k.reply_key, s.session))""")
def prefix_purge_nested(spark, d):
    """Keys ``customer:year:month:day`` purged by sessions that hold the separator and are prefixes of others: a user with an
    error purges ``user:``, every user ``user:1996``."""
    day = F.replace(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), F.lit(":"))
    keys = table(spark, d, "orders").select("o_orderkey", F.concat(F.col("o_custkey").cast("string"), F.lit(":"), day).alias("reply_key"))
    end = F.when(F.col("event_type") == "error", F.lit(":")).otherwise(F.lit(":1996"))
    sessions = table(spark, d, "events").select(F.concat(F.col("user_id").cast("string"), end).alias("session"))
    return purge_prefix(keys, sessions, "reply_key", "session")


def known_profiles(spark, d):
    """Profiles of six customers in seven, so that lookups find and miss."""
    return table(spark, d, "customer").where(F.col("c_custkey") % 7 != 0).select("c_custkey", "c_name")


@query("profile_lookup", """
    SELECT o.o_orderkey, c.c_name, c.c_custkey IS NULL AS error FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_custkey % 7 <> 0""")
def profile_lookup(spark, d):
    """Action -> profile lookup; a missing profile is an error row, not a dropped one."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = known_profiles(spark, d)
    j = o.join(c, o.o_custkey == c.c_custkey, "left")
    return j.select("o_orderkey", "c_name", F.col("c_custkey").isNull().alias("error"))


@query("zip_join", """
    WITH a AS (SELECT item_id AS id, string_split(text, ' ') AS w FROM benchmark),
    b AS (SELECT doc_id AS id, string_split(text, ' ') AS w FROM documents),
    ea AS (SELECT id, (generate_subscripts(w, 1) - 1)::INTEGER AS pos, unnest(w) AS a FROM a),
    eb AS (SELECT id, (generate_subscripts(w, 1) - 1)::INTEGER AS pos, unnest(w) AS b FROM b)
    SELECT ea.id, ea.pos, ea.a, eb.b FROM ea JOIN eb USING (id, pos)""")
def zip_join(spark, d):
    """Words of a benchmark item paired by position with the words of the
    document of the same id; stops at the shorter."""
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.split("text", " ").alias("wa"))
    b = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.split("text", " ").alias("wb"))
    return zip_pair(a, b, "id", "wa", "wb").select("id", "pos", "a", "b")


@query("attach_context", """
    SELECT conv_id, (SELECT 'Sections: ' || string_agg(DISTINCT p_type, ', ' ORDER BY p_type) FROM part) AS context
    FROM (SELECT DISTINCT conv_id FROM conversations)""")
def attach_context_q(spark, d):
    """One shared context text on every session (scalar subquery)."""
    ctx = table(spark, d, "part").agg(
        F.concat(F.lit("Sections: "), F.array_join(F.array_sort(F.collect_set("p_type")), ", ")).alias("context")
    )
    sessions = table(spark, d, "conversations").select("conv_id").distinct()
    return attach_context(sessions, ctx)


@query("ordered_steps", """
    SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS step FROM documents""")
def ordered_steps_q(spark, d):
    """Deterministic step order per source (explicit order column)."""
    return ordered_steps(table(spark, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"])


# the same scans with null group keys, null values and several actions at one instant
_TIES_SQL = _STATE_SQL.replace(
    f"a AS (SELECT event_id, user_id, ts, event_type, {EVENT_MID} AS mid FROM events)",
    f"a AS (SELECT event_id, nullif(user_id % 5, 3) AS user_id, date_trunc('day', ts) AS ts, event_type, {EVENT_MID} AS mid FROM events)")


@query("session_epochs_ties", f"""
    WITH {_TIES_SQL}
    SELECT event_id, user_id, mid, epoch::BIGINT AS epoch, started, last_start_ts FROM st""")
def session_epochs_ties(spark, d):
    """Session state where a session key is null and many actions share an instant."""
    a = _actions(spark, d).select(
        "event_id", F.nullif(F.col("user_id") % 5, F.lit(3)).alias("user_id"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), "event_type", "mid")
    return session_state(a, "user_id", SEQ, "ts").select("event_id", "user_id", "mid", "epoch", "started", "last_start_ts")


@query("running_totals_nulls", """
    SELECT event_id, nullif(user_id % 4, 1) AS g,
           row_number() OVER w AS n, sum(CASE WHEN event_id % 3 = 0 THEN event_id END) OVER w::BIGINT AS run,
           max(CASE WHEN event_id % 5 = 0 THEN value END) OVER w AS top
    FROM events WINDOW w AS (PARTITION BY nullif(user_id % 4, 1) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_totals_nulls(spark, d):
    """Numbers, running sums and maxima with null groups and values, a few hot groups over many ranges."""
    e = table(spark, d, "events").select("event_id", "ts", "value", F.nullif(F.col("user_id") % 4, F.lit(1)).alias("g"))
    s = grouped_scan(e, ["g"], SEQ, number="n", sums={"run": F.when(F.col("event_id") % 3 == 0, F.col("event_id"))},
                     maxes={"top": F.when(F.col("event_id") % 5 == 0, F.col("value"))}, slices=64)
    return s.select("event_id", "g", "n", "run", "top")
