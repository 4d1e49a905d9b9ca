"""Queries: Structured Streaming operators, each run to completion
(availableNow) over the table's files and written to the shared folder.
Their oracle is the batch twin's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.embed import with_counts
from ..session import scratch_path, table
from ..sources.change_source import read_change_log
from ..sources.changes import event_op, events_as_actions
from ..sources.reported_sink import delivery_reports, write_delivered
from ..sources.vector_store import to_points
from ..streaming.runner import read_output, read_staged, read_table_stream, run_to_table, staged
from ..streaming.streams import (
    correlate_stream,
    current_rows,
    drain,
    rag_turn_step,
    reply_join,
    run_append,
    run_live_first,
    run_live_state,
    session_clock,
    session_ends,
    session_turns,
    split_stream,
)
from . import q_changes, q_sessions, q_vectors
from .registry import ORACLE, query
from .sqlparts import EVENT_OP

SEQ = ["ts", "event_id"]


def _batches(spark, d, name, order):
    """A stream over a table in three micro-batches by ``order``."""
    t = table(spark, d, name)
    path, files = staged(spark, t, order)
    return read_staged(spark, path, t.schema, files)


def _actions_stream(s):
    return s.where(F.col("role") == "user").select(
        F.col("conv_id").cast("string").alias("key"),
        F.concat(F.lit("guest-"), F.col("conv_id").cast("string")).alias("username"),
        F.lit(None).cast("string").alias("waiter_name"),
        F.lit(None).cast("string").alias("context"),
        F.col("text").alias("query"),
        F.col("turn").alias("mid"),
    )


@query("stream_actions", """
    SELECT conv_id::VARCHAR AS key, 'guest-' || conv_id::VARCHAR AS username, NULL::VARCHAR AS waiter_name,
           NULL::VARCHAR AS context, text AS query, turn AS mid FROM conversations WHERE role = 'user'""")
def stream_actions(spark, d):
    """Keyed action stream with declared columns (conversation user turns)."""
    s = read_table_stream(spark, d, "conversations")
    out = run_append(_actions_stream(s), name="stream_actions")
    return spark.read.parquet(out)


@query("stream_profile_lookup", ORACLE["profile_lookup"])
def stream_profile_lookup(spark, d):
    """Stream-static left join: every incoming action finds its profile, or
    is kept with ``error`` set (never dropped).  The static side is left to
    the planner (broadcast only when AQE sees it is small)."""
    s = read_table_stream(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = q_sessions.known_profiles(spark, d)
    j = s.join(c, s.o_custkey == c.c_custkey, "left").select(
        "o_orderkey", "c_name", F.col("c_custkey").isNull().alias("error")
    )
    return spark.read.parquet(run_append(j, name="stream_profile_lookup"))


@query("stream_inferred", "SELECT * FROM events")
def stream_inferred(spark, d):
    """Stream whose columns come from the stored files' metadata."""
    out = run_append(read_table_stream(spark, d, "events"), name="stream_inferred")
    return spark.read.parquet(out)


@query("resume_exactly_once", "SELECT event_id, user_id, event_type FROM events")
def resume_exactly_once(spark, d):
    """Run, stop, new files, restart on the same checkpoint: every row exactly once."""
    base = scratch_path(spark, "resume")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    for part in range(2):
        e.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{base}/in")
        run_to_table(spark.readStream.schema(e.schema).parquet(f"{base}/in"), base=base)
    return spark.read.parquet(f"{base}/out")


@query("stream_change_log", f"SELECT event_id, user_id, {EVENT_OP} AS op, value FROM events")
def stream_change_log(spark, d):
    """The change log as a source of its own: read from its first row, stopped, and resumed on what came since."""
    base = scratch_path(spark, "change_log")
    e = table(spark, d, "events").select("event_id", "ts", "user_id", event_op().alias("op"), "value")
    half = e.agg(((F.min("event_id") + F.max("event_id")) / 2).cast("long")).first()[0]
    for later in (False, True):
        e.where((F.col("event_id") > half) == F.lit(later)).write.mode("append").parquet(f"{base}/log")
        log = read_change_log(spark, f"{base}/log", seq="event_id", schema=e.schema)
        run_to_table(log.select("event_id", "user_id", "op", "value"), base=base)
    return spark.read.parquet(f"{base}/out")


@query("stream_delivery_report", """
    SELECT sum(CASE WHEN user_id % 10 <> 3 THEN 1 ELSE 0 END)::BIGINT AS rows, sum(CASE WHEN user_id % 10 = 3 THEN 1 ELSE 0 END)::BIGINT AS failed,
           min(user_id) FILTER (user_id % 10 <> 3) AS min_key, max(user_id) FILTER (user_id % 10 <> 3) AS max_key FROM events""")
def stream_delivery_report(spark, d):
    """Events delivered by a stream to the reporting sink, over its batches' reports; keys that end in 3 are taken away, so
    those rows fail."""
    base = scratch_path(spark, "delivery")
    s = _batches(spark, d, "events", "event_id").select(F.when(F.col("user_id") % 10 != 3, F.col("user_id")).alias("user_id"), "event_id")
    write_delivered(s, f"{base}/out", "user_id", f"{base}/chk")
    r = delivery_reports(spark, f"{base}/out")
    return r.agg(F.sum("rows").alias("rows"), F.sum("failed").alias("failed"), F.min(F.col("min_key").cast("long")).alias("min_key"), F.max(F.col("max_key").cast("long")).alias("max_key"))


@query("drain_once", "SELECT event_id, ts, (event_id % 2)::INTEGER AS call FROM events")
def drain_once(spark, d):
    """Drains on one checkpoint: each call hands out what came since the last one, and a call without new rows
    hands out none."""
    base = scratch_path(spark, "drain")
    e = table(spark, d, "events").select("event_id", "ts")
    out = None
    for call in range(3):
        if call < 2:
            e.where(F.col("event_id") % 2 == call).write.mode("append").parquet(f"{base}/in")
        got = drain(spark.readStream.schema(e.schema).parquet(f"{base}/in"), base).withColumn("call", F.lit(call))
        out = got if out is None else out.unionByName(got)
    return out


@query("stream_vdb_record", ORACLE["vdb_record"])
def stream_vdb_record(spark, d):
    """Change stream of documents -> collection points, per micro-batch."""
    lab = table(spark, d, "labels").select("doc_id", "toxic")
    s = read_table_stream(spark, d, "documents").join(lab, "doc_id", "left").select(
        "doc_id", "text", F.when(F.col("toxic") == 1, F.lit("d")).otherwise(F.lit("c")).alias("op")
    )

    pts = to_points(s, "doc_id", "text", dim=q_vectors.DIM_TEXT)  # embeds inside the row: a plain append query
    nb = F.when(F.col("vector").isNotNull(), F.size("vector.idx").cast("long"))
    out = run_append(pts.select("collection_name", "id", "title", "description", "embed_text", nb.alias("n_buckets")), name="stream_vdb_record")
    return spark.read.parquet(out)


@query("stream_actions_embedded", f"""
    WITH q AS (SELECT conv_id * 1000000 + turn AS qid, conv_id, turn, text FROM conversations WHERE role = 'user'),
    t AS {q_vectors.hashed_terms_sql('q', 'qid', 'text', q_vectors.DIM_TEXT)}
    SELECT q.conv_id::VARCHAR AS key, q.turn AS mid, n.n_buckets FROM q LEFT JOIN (SELECT id, count(*) AS n_buckets FROM t GROUP BY id) n ON n.id = q.qid""")
def stream_actions_embedded(spark, d):
    """Actions + the vector of their query, re-keyed by session."""
    s = read_table_stream(spark, d, "conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")
    n = F.when(F.size("_idx") > 0, F.size("_idx").cast("long"))
    r = with_counts(s, "text", q_vectors.DIM_TEXT).select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("mid"), n.alias("n_buckets"))
    return spark.read.parquet(run_append(r, name="stream_actions_embedded"))


_SESSION_TURNS_SQL = f"""
    WITH {q_sessions._STATE_SQL},
    nv AS (SELECT *, row_number() OVER (PARTITION BY user_id, epoch, event_type, (mid IS NOT NULL AND mid <> 0 AND started)
                                        ORDER BY ts, event_id) AS fr FROM st)
    SELECT user_id, event_id, mid,
           CASE WHEN mid IS NULL THEN 'logout' WHEN mid = 0 THEN 'start' ELSE 'message' END AS action,
           epoch::BIGINT AS epoch, started,
           CASE WHEN mid IS NOT NULL AND mid <> 0 AND started THEN fr = 1 END AS novel,
           CASE WHEN mid IS NULL THEN 'closed' WHEN mid <> 0 AND NOT started THEN 'error' ELSE 'ok' END AS status,
           CASE WHEN mid IS NOT NULL AND mid <> 0 AND NOT started THEN '{q_sessions._ERROR}' END AS response,
           CASE WHEN mid IS NOT NULL AND mid <> 0 AND NOT started THEN -1 END AS total_tokens
    FROM nv"""


@query("session_turns", _SESSION_TURNS_SQL)
def session_turns_q(spark, d):
    """Session state machine as a stateful stream (start / message / logout,
    title novelty per epoch, error replies for orphan messages)."""
    s = events_as_actions(_batches(spark, d, "events", "ts")).select(
        "user_id", "event_id", "ts", "mid", F.col("event_type").alias("title")
    )
    out = run_append(session_turns(s), name="session_turns")
    return spark.read.parquet(out)


@query("stream_session_timeout", ORACLE["session_timeout"])
def stream_session_timeout(spark, d):
    """Login lasts one hour, on a stream: per-session clock in state."""
    s = events_as_actions(_batches(spark, d, "events", "ts")).select("user_id", "event_id", "ts", "mid")
    out = run_append(session_clock(s, 3600), name="stream_session_timeout")
    return spark.read.parquet(out)


@query("stream_quarantine", ORACLE["quarantine"])
def stream_quarantine(spark, d):
    """Poison rows on a stream: the change log's row contract splits every
    micro-batch into a good sink and a quarantine sink (reason per row)."""
    out = run_to_table(_batches(spark, d, "events", "event_id"), name="stream_quarantine",
                       foreach_batch=split_stream(q_changes.event_rules(), ["event_id"]))
    return read_output(spark, f"{out}/bad", T.StructType([T.StructField("event_id", T.LongType()), T.StructField("reason", T.StringType())]))


@query("stream_current_state", ORACLE["cdc_current_state"])
def stream_current_state(spark, d):
    """Live current state of a change stream: a streaming aggregation in update mode keeps the last row of each key,
    every micro-batch writes the rows it changed, the state is the last of those."""
    s = _batches(spark, d, "events", "event_id").select(
        "user_id", event_op().alias("op"), "value", "props", "ts", "event_id"
    )
    base = scratch_path(spark, "stream_current_state")
    run_live_state(s, "user_id", SEQ, base)
    return current_rows(spark, base, s.schema, "user_id", SEQ).where(F.col("op") != "d")


@query("stream_first_titles", """
    SELECT user_id, event_type AS title, ts, event_id
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1""")
def stream_first_titles(spark, d):
    """The first time each user gets each title, on a stream whose batches are not in time order."""
    s = _batches(spark, d, "events", "event_id").select("user_id", F.col("event_type").alias("title"), "ts", "event_id")
    return run_live_first(s, ["user_id"], "title", SEQ, scratch_path(spark, "stream_first_titles")).select("user_id", "title", *SEQ)


def _with_sentinel(spark, stream, last, run):
    """Run ``run(stream + an empty folder)``, then once more on its checkpoint with a row later than everything in that
    folder, so that the watermark passes every deadline only after all data has been seen."""
    folder = scratch_path(spark, "sentinel")
    spark.createDataFrame([], stream.schema).write.parquet(folder)
    both = lambda: run(stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder)))
    both()
    last.write.mode("append").parquet(folder)
    return both()


@query("stream_session_ends", """
    WITH c AS (SELECT user_id, event_type, epoch_us(ts) AS t, lead(event_type) OVER w AS nxt, epoch_us(lead(ts) OVER w) AS nt
               FROM events WHERE event_type IN ('signup', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, t AS start_us, CASE WHEN nt <= t + 3600000000 THEN nt ELSE t + 3600000000 END AS end_us,
           CASE WHEN nt <= t + 3600000000 THEN CASE WHEN nxt = 'error' THEN 'logout' ELSE 'restart' END ELSE 'expired' END AS reason
    FROM c WHERE event_type = 'signup'""")
def stream_session_ends(spark, d):
    """How each session ends on a stream: by logout, by a new start, or by a timer an hour after its start."""
    base = scratch_path(spark, "stream_session_ends")
    s = events_as_actions(_batches(spark, d, "events", "ts")).select("user_id", "event_id", "ts", "mid")
    last = table(spark, d, "events").agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit(None).cast("long").alias("mid"))
    out = _with_sentinel(spark, s, last, lambda x: run_to_table(session_ends(x, 3600), base=base))  # a logout without a session gives no row
    return spark.read.parquet(out)


_REPLY_LIMIT = 120


@query("stream_turn_replies", f"""
    WITH u AS (SELECT DISTINCT conv_id::VARCHAR AS session, turn::VARCHAR AS mid, turn * 60 AS t FROM conversations WHERE role = 'user'),
    a AS (SELECT conv_id::VARCHAR AS session, (turn - 1)::VARCHAR AS mid, (turn - 1) * 60 + length(coalesce(text, '')) % 240 AS t, turn FROM conversations WHERE role = 'assistant'),
    m AS (SELECT u.session, u.mid, u.t, min(row(a.t, a.turn)) FILTER (a.t IS NOT NULL) AS f FROM u LEFT JOIN a
          ON a.session = u.session AND a.mid = u.mid AND a.t BETWEEN u.t AND u.t + {_REPLY_LIMIT} GROUP BY ALL)
    SELECT session, mid, f[2] AS reply_turn, f[1] - t AS waited_s, CASE WHEN f IS NULL THEN 'timeout' ELSE 'matched' END AS status FROM m""")
def stream_turn_replies(spark, d):
    """User turn -> the assistant's reply to it, correlated on (session, mid) as texts within 120 s by a stream-stream join.
    A turn's time is its number in minutes; a reply comes as many seconds later as its text is long, modulo 240."""
    base = scratch_path(spark, "stream_turn_replies")
    c = _batches(spark, d, "conversations", "turn").select("conv_id", "turn", "role", "text")
    last = spark.createDataFrame([(-1, 10_000_000, r, "") for r in ("user", "assistant")], "conv_id long, turn long, role string, text string").select(
        *[F.col(f.name).cast(f.dataType) for f in c.schema])

    def run(s):
        late = F.when(F.col("role") == "user", F.lit(0)).otherwise(F.length(F.coalesce("text", F.lit(""))) % 240)
        mid = F.col("turn") - F.when(F.col("role") == "user", 0).otherwise(1)
        t = s.select(F.col("conv_id").cast("string").alias("session"), mid.cast("string").alias("mid"), "role", "turn", F.timestamp_seconds(86400 + mid * 60 + late).alias("at"))  # a day on: a stream starts with the watermark 0
        asked = t.where("role = 'user'").select("session", "mid", F.col("at").alias("req_ts"))
        told = t.where("role = 'assistant'").select("session", "mid", F.col("at").alias("resp_ts"), "turn")
        return run_to_table(reply_join(asked, told, ["session", "mid"], "req_ts", "resp_ts", _REPLY_LIMIT, delay="4 minutes"), base=base)

    r = spark.read.parquet(_with_sentinel(spark, c, last, run)).where("session <> '-1'")
    waited = (F.unix_seconds("reply.resp_ts") - F.unix_seconds("req_ts")).alias("waited_s")
    return r.select("session", "mid", F.col("reply.turn").alias("reply_turn"), waited, "status")


@query("stream_request_response", ORACLE["request_response"])
def stream_request_response(spark, d):
    """Click -> first purchase within 2 h on a stream (state per user, event
    time timeouts, no pairs).  The query also reads a sentinel folder, empty
    on the first run; after the events are processed a sentinel (a response
    one day after the last event, on a key of its own) is written there and
    the same query restarts on its checkpoint, so the watermark passes every
    deadline only after all data has been seen."""
    ev = _batches(spark, d, "events", "ts").where(F.col("event_type").isin("click", "purchase")).select(
        "user_id", F.col("event_id").alias("id"), "ts", F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("kind")
    )
    base = scratch_path(spark, "stream_request_response")
    sent_dir = f"{base}/sentinel"
    spark.createDataFrame([], ev.schema).write.parquet(sent_dir)

    def run():
        sent = spark.readStream.schema(ev.schema).parquet(sent_dir)
        return run_to_table(correlate_stream(ev.unionByName(sent), 7200), base=base)

    run()
    last = table(spark, d, "events").agg(F.max("ts").alias("ts"))
    last.select(F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("id"),
                (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit(1).alias("kind")).write.mode("append").parquet(sent_dir)
    out = run()
    r = spark.read.parquet(out)  # the sentinel is a response: it gives no row
    ev_b = table(spark, d, "events").select("event_id", "ts")
    res = ev_b.select(F.col("event_id").alias("resp_event_id"), F.col("ts").alias("resp_ts"))
    ok = F.col("status") == "matched"
    return (
        r.join(ev_b, "event_id").join(res, "resp_event_id", "left")
        .select(
            "user_id", "event_id", "ts", "resp_event_id", "resp_ts",
            F.when(ok, ((F.col("resp_us") - F.col("ts_us")) / 1000).cast("long")).alias("latency_ms"),
            "status",
            F.when(~ok, F.lit(q_sessions.TIMEOUT_REPLY)).alias("reply"),
        )
    )


@query("stream_rag_turn", ORACLE["rag_context"])
def stream_rag_turn(spark, d):
    """Whole turn on a stream: action -> embed -> top-k -> novelty across
    micro-batches (titles given so far, by batch) -> context rows."""
    _, corpus, texts = q_vectors.rag_inputs(spark, d)
    s = _batches(spark, d, "conversations", "turn").where(F.col("role") == "user").select(
        q_vectors.turn_key().alias("qid"), "conv_id", "turn", F.col("text").alias("query")
    )
    step = rag_turn_step(corpus, 2, 0.3, ["conv_id"], "turn", q_vectors.DIM_TEXT, texts=texts, n_corpus=corpus.count())
    out = run_to_table(s, name="stream_rag_turn", foreach_batch=step)
    return spark.read.parquet(f"{out}/ctx").select("conv_id", "turn", "context", "n_items")
