"""Streaming operators (Structured Streaming) and their runs.

Stateless enrichment runs as plain ``readStream -> select -> writeStream``
(append, every change emitted, nothing coalesced).  Work that needs batch
operators (aggregations, top-k, snapshot merges) runs per micro-batch in
``foreachBatch`` with idempotent, batch-id-keyed writes.  Per-key state
machines run in ``applyInPandasWithState`` on the RocksDB state store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.time import epoch_us
from ..operators.cdc import compact
from ..operators.retrieve import CONTEXT_HEADING, context_block, novel_hits
from ..session import scratch_path
from .processors import (
    CLOCK_OUT,
    CLOCK_STATE,
    CORRELATE_OUT,
    CORRELATE_STATE,
    ENDS_OUT,
    ENDS_STATE,
    KEYS,
    NEVER,
    NONE,
    SESSION_OUT,
    SESSION_STATE,
    make_correlator,
    make_session_clock,
    make_session_ends,
    session_machine,
)
from .runner import read_if_there, read_output, run_to_table


def run_append(df: DataFrame, base: str | None = None, name: str = "append") -> str:
    """Continuous append query: every input row (change) is emitted."""
    return run_to_table(df, base, name)


def _marked(actions: DataFrame) -> DataFrame:
    """``mid`` without nulls beside a ``logout`` mark: a column with nulls reaches pandas as float64, which rounds large ids."""
    return actions.withColumn("logout", F.col("mid").isNull()).withColumn("mid", F.coalesce(F.col("mid"), F.lit(0).cast("long")))


def session_turns(actions: DataFrame) -> DataFrame:
    """Per-session state machine over (user_id, event_id, ts, mid, title)."""
    return _marked(actions).groupBy("user_id").applyInPandasWithState(
        session_machine, SESSION_OUT, SESSION_STATE, "append", GroupStateTimeout.NoTimeout
    )


def split_stream(rules: dict, id_cols: list[str]):
    """foreachBatch step for poison rows: good rows to ``out/good``, broken
    rows (one row per broken rule) to ``out/bad``; the stream never fails on
    a bad row.  Writes are keyed by batch id (a replay overwrites itself)."""
    from ..operators.quality import with_reasons

    def step(batch: DataFrame, batch_id: int, out: str) -> None:
        r = with_reasons(batch, rules).persist()
        r.where(F.size("reasons") == 0).drop("reasons").write.mode("overwrite").parquet(f"{out}/good/batch={batch_id}")
        r.where(F.size("reasons") > 0).select(*id_cols, F.explode("reasons").alias("reason")).write.mode(
            "overwrite").parquet(f"{out}/bad/batch={batch_id}")
        r.unpersist()

    return step


def session_clock(actions: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """Login expiry on a stream of (user_id, event_id, ts, mid)."""
    a = _marked(actions).withColumn("t", epoch_us(F.col("ts"), actions.schema["ts"].dataType))
    return a.groupBy("user_id").applyInPandasWithState(
        make_session_clock(ttl_seconds * 1_000_000), CLOCK_OUT, CLOCK_STATE, "append", GroupStateTimeout.NoTimeout
    )


def _dealt(rows: DataFrame):
    """Rows by the group that their user is dealt to, with ``user_id`` free of nulls beside a ``no_user`` mark: a state
    function then serves many users at once, and what a call costs does not grow with their number."""
    marked = rows.withColumn("no_user", F.col("user_id").isNull().cast("long")).withColumn("user_id", F.coalesce(F.col("user_id").cast("long"), F.lit(0)))
    return marked.withColumn("_group", F.pmod(F.xxhash64("no_user", "user_id"), F.lit(KEYS))).groupBy("_group")


def correlate_stream(events: DataFrame, limit_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """As-of request/response correlation on a stream of
    (user_id, id, ts, kind 0=request/1=response); unmatched requests time out
    when the watermark passes their limit."""
    # event time as an instant built from UTC micros (no session-zone shift)
    ev = events.withColumn("t", epoch_us(F.col("ts"), events.schema["ts"].dataType))
    ev = ev.withColumn("ets", F.timestamp_micros("t")).withWatermark("ets", delay)
    ev = ev.select("user_id", F.coalesce("t", F.lit(NEVER)).alias("t"), F.col("kind").cast("long").alias("kind"),
                   F.coalesce("id", F.lit(NONE)).alias("id"), "ets")  # a column with nulls would reach pandas as float64
    return _dealt(ev).applyInPandasWithState(
        make_correlator(limit_seconds * 1_000_000), CORRELATE_OUT, CORRELATE_STATE, "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def reply_join(requests: DataFrame, replies: DataFrame, keys: list[str], req_ts: str, resp_ts: str, limit_seconds: int,
               delay: str = "0 seconds") -> DataFrame:
    """First reply of each request within ``limit_seconds``, by Spark's own stream-stream join: keys, ``req_ts``, ``status``
    (matched / timeout) and ``reply`` (the first reply's columns; null on a timeout).

    Both sides are watermarked; a left outer interval join holds a request until the watermark has passed its limit, and an
    aggregation over its (keys, time) keeps the earliest reply (ties by the other columns).  Keys may be of any type and
    match null-safely only if neither is null; requests that repeat keys and time are one.  ``req_ts`` and ``resp_ts`` are
    instants (``timestamp``)."""
    columns = [c for c in replies.columns if c not in keys]
    q = requests.select(*[F.col(k).alias(f"_q_{k}") for k in keys], F.col(req_ts)).withWatermark(req_ts, delay)
    r = replies.withWatermark(resp_ts, delay)
    on = (F.col(resp_ts) >= F.col(req_ts)) & (F.col(resp_ts) <= F.col(req_ts) + F.expr(f"INTERVAL {int(limit_seconds)} SECOND"))
    for k in keys:
        on = (F.col(f"_q_{k}") == F.col(k)) & on
    order = F.struct(F.col(resp_ts), *[F.col(c) for c in columns if c != resp_ts])
    # the groups are windows of a request's own instant: the time stays the event time of the result
    first = q.join(r, on, "left_outer").groupBy(F.window(req_ts, "1 microsecond").alias("_w"), *[f"_q_{k}" for k in keys]).agg(
        F.min_by(F.when(F.col(resp_ts).isNotNull(), F.struct(*columns)), order).alias("reply"))
    return first.select(*[F.col(f"_q_{k}").alias(k) for k in keys], F.col("_w.start").alias(req_ts),
                        F.when(F.col("reply").isNull(), F.lit("timeout")).otherwise(F.lit("matched")).alias("status"), "reply")


def session_ends(actions: DataFrame, ttl_seconds: int = 3600, delay: str = "0 seconds") -> DataFrame:
    """One row per session of a stream of (user_id, event_id, ts, mid), when it ends: ``user_id, start_us, end_us, reason``
    (logout, restart, or expired ``ttl_seconds`` after the start).  A timer ends a session that nothing follows; an ended
    session leaves no state."""
    a = actions.where(F.col("mid").isNull() | (F.col("mid") == 0)).withColumn("t", epoch_us(F.col("ts"), actions.schema["ts"].dataType))
    a = a.withColumn("ets", F.timestamp_micros("t")).withWatermark("ets", delay)
    a = a.select("user_id", "t", F.coalesce("event_id", F.lit(NEVER)).alias("event_id"), F.col("mid").isNotNull().cast("long").alias("start"), "ets")
    return _dealt(a).applyInPandasWithState(
        make_session_ends(ttl_seconds * 1_000_000), ENDS_OUT, ENDS_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ---------------------------------------------------------------------------
# current state of a change stream, in Spark's own state
# ---------------------------------------------------------------------------


def live_state(changes: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """Last write per key of a change stream: a streaming ``max_by`` whose state Spark keeps (RocksDB).  In update mode every
    micro-batch gives the rows of the keys it changed, and no others.  Partial sums before the shuffle: a hot key is one row a task."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_last")).select(key, "_last.*")


def live_first(hits: DataFrame, session: list[str], title: str, order: list[str]) -> DataFrame:
    """First hit of each title in its session (epoch) on a stream: the twin of ``first_in_epoch``.  The state is one row per
    (session, title), spread over the tasks by both, not a set per session; in update mode a batch gives the titles that are
    new to their session, and a title again only if an earlier hit of it arrives late."""
    rest = [c for c in hits.columns if c not in (*session, title)]
    first = hits.groupBy(*session, title).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*session, title, "_first.*")


def run_live_first(hits: DataFrame, session: list[str], title: str, order: list[str], base: str) -> DataFrame:
    """Run the stream below ``base``; the first hits so far.  A batch writes what it found for the titles it touched; the
    first of those is the answer."""
    from ..operators.retrieve import first_in_epoch

    run_to_table(live_first(hits, session, title, order), base=base, mode="update", foreach_batch=write_changed)
    return first_in_epoch(read_output(hits.sparkSession, f"{base}/out", hits.schema), session, title, order)


def write_changed(batch: DataFrame, batch_id: int, out: str) -> None:
    """foreachBatch step: the changed rows of a micro-batch, by its id; a batch that runs again writes the same rows again."""
    batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def run_live_state(changes: DataFrame, key: str, seq: list[str], base: str) -> None:
    """Run the change stream below ``base`` and write what changes (a restart goes on where it stopped)."""
    run_to_table(live_state(changes, key, seq), base=base, mode="update", foreach_batch=write_changed)


def current_rows(spark: SparkSession, base: str, schema, key: str, seq: list[str]) -> DataFrame:
    """The current state: the last of each key's written rows, tombstones kept; no rows before the first batch."""
    return compact(read_output(spark, f"{base}/out", schema), key, seq)


def drain(stream: DataFrame, base: str) -> DataFrame:
    """Incremental drain: rows not handed out by an earlier call on the same
    ``base`` (its checkpoint), each exactly once."""
    spark = stream.sparkSession
    run_id = scratch_path(spark, "drain").rsplit("/", 1)[-1]
    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/out/run={run_id}/batch=-1")  # a call may hand out nothing
    out = run_to_table(stream, base=base, name="drain",
                       foreach_batch=lambda b, i, o: b.write.mode("overwrite").parquet(f"{o}/run={run_id}/batch={i}"))
    return read_output(spark, f"{out}/run={run_id}", stream.schema)


def rag_turn_step(corpus: DataFrame, k: int, min_score: float, session: list[str], turn: str, dim: int = 384,
                  supplied: str | None = None, heading: str = CONTEXT_HEADING, texts: DataFrame | None = None,
                  n_corpus: int | None = None):
    """foreachBatch step of the retrieval turn: embed + top-k against the
    static corpus, drop titles given in earlier batches, write the context
    rows and the titles this batch gave, both by batch id."""
    from ..functions.embed import with_vector
    from ..operators.spread import materialize

    def step(batch: DataFrame, batch_id: int, out: str) -> None:
        spark = batch.sparkSession
        actions = materialize(with_vector(batch, "query", dim), "actions")  # embedded once: the batch is used several times
        # titles given in earlier batches; a batch that runs again reads and writes the same
        seen = read_if_there(spark, f"{out}/seen", T.StructType([*[batch.schema[c] for c in session], T.StructField("title", T.StringType()), T.StructField("batch", T.LongType())]))
        seen = seen.where(F.col("batch") < batch_id) if seen is not None else None
        novel = materialize(novel_hits(actions, corpus, k, min_score, session, turn, seen=seen, sparse_dim=dim, n_corpus=n_corpus), "novel")
        context_block(actions, novel, session, turn, supplied, heading, texts if texts is not None else corpus).write.mode("overwrite").parquet(f"{out}/ctx/batch={batch_id}")
        novel.select(*session, "title").distinct().write.mode("overwrite").parquet(f"{out}/seen/batch={batch_id}")

    return step
