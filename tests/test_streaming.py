"""Streaming operators equal their batch twins over several micro-batches."""

import datetime as dt
import glob
import tempfile

from pyspark.sql import functions as F

from ferrule.sources.changes import event_op, events_as_actions
from ferrule.streaming.runner import run_to_table
from ferrule.streaming.streams import correlate_stream, current_rows, reply_join, run_live_state, session_clock, session_ends, session_turns
from tests.conftest import SF_SMALL, rows

import __spark_entry__ as E


def staged_events(spark, parts=4, sentinel=False):
    """The events table cut into ``parts`` files by time, so a stream over it
    with maxFilesPerTrigger=1 runs ``parts`` micro-batches in time order."""
    d = tempfile.mkdtemp(prefix="ferrule-stage-")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    b = ev.select(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    span = (b["hi"] - b["lo"]) / parts
    for i in range(parts):
        lo, hi = b["lo"] + span * i, b["lo"] + span * (i + 1)
        part = ev.where((F.col("ts") >= lo) & ((F.col("ts") < hi) if i < parts - 1 else F.lit(True)))
        part.coalesce(1).write.parquet(f"{d}/part={i:02d}")
    files = sorted(glob.glob(f"{d}/part=*/*.parquet"))
    flat = tempfile.mkdtemp(prefix="ferrule-flat-")
    import os
    import shutil

    if sentinel:
        # a late row on a key of its own, in the last file: moves the watermark past everything
        last = ev.agg(F.max("ts").alias("ts")).first()["ts"]
        row = ev.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(last + dt.timedelta(days=1)).cast(ev.schema["ts"].dataType).alias("ts"),
                                 F.lit(-1).cast("long").alias("user_id"), F.lit("purchase").alias("event_type"), "value", "props")
        row.coalesce(1).write.parquet(f"{d}/sentinel")
        files += glob.glob(f"{d}/sentinel/*.parquet")
    for i, f in enumerate(files):
        shutil.copy(f, f"{flat}/{i:03d}.parquet")
        os.utime(f"{flat}/{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return flat, ev.schema


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_session_turns_stream_equals_batch(spark, duck):
    path, schema = staged_events(spark)
    s = events_as_actions(stream(spark, path, schema)).select("user_id", "event_id", "ts", "mid", F.col("event_type").alias("title"))
    out = run_to_table(session_turns(s), name="t_session")
    got = spark.read.parquet(out)
    want = duck.execute(E.oracle_sql()["session_turns"]).df()
    cols = sorted(want.columns)
    assert sorted(map(tuple, got.select(*cols).toPandas().astype(object).where(lambda x: x.notna(), None).values.tolist())) == sorted(
        map(tuple, want[cols].astype(object).where(want[cols].notna(), None).values.tolist()))


def test_current_state_stream_equals_batch(spark):
    path, schema = staged_events(spark)
    s = stream(spark, path, schema).select("user_id", event_op().alias("op"), "value", "props", "ts", "event_id")
    base = tempfile.mkdtemp(prefix="ferrule-state-")
    run_live_state(s, "user_id", ["ts", "event_id"], base)
    got = current_rows(spark, base, s.schema, "user_id", ["ts", "event_id"]).where("op != 'd'")
    want = E.queries()["cdc_current_state"](spark, SF_SMALL)
    cols = ["user_id", "op", "value", "props", "event_id"]
    assert rows(got, cols) == rows(want, cols)
    assert len(glob.glob(f"{base}/out/batch=*")) >= 4


def test_correlate_stream_equals_batch(spark):
    path, schema = staged_events(spark, sentinel=True)
    ev = stream(spark, path, schema).where(F.col("event_type").isin("click", "purchase")).select(
        "user_id", F.col("event_id").alias("id"), "ts", F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("kind"))
    out = run_to_table(correlate_stream(ev, 7200), name="t_corr")
    got = spark.read.parquet(out).where("user_id >= 0")
    want = E.queries()["request_response"](spark, SF_SMALL)
    assert rows(got, ["event_id", "resp_event_id", "status"]) == rows(want, ["event_id", "resp_event_id", "status"])


def test_resume_and_drain_exactly_once(spark):
    q = E.queries()
    n = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert q["resume_exactly_once"](spark, SF_SMALL).count() == n
    assert q["drain_once"](spark, SF_SMALL).count() == n


def test_session_clock_stream_equals_batch(spark):
    path, schema = staged_events(spark)
    s = events_as_actions(stream(spark, path, schema)).select("user_id", "event_id", "ts", "mid")
    got = spark.read.parquet(run_to_table(session_clock(s, 3600), name="t_clock"))
    want = E.queries()["session_timeout"](spark, SF_SMALL)
    cols = ["event_id", "user_id", "status", "session_age_s"]
    assert rows(got, cols) == rows(want, cols)


STATE = "k long, t long, v string"


def put(spark, folder, *data):
    spark.createDataFrame(data, STATE).coalesce(1).write.mode("append").parquet(folder)


def test_a_batch_that_fails_is_written_again_and_only_changed_rows_are_written(spark, monkeypatch):
    from ferrule.streaming import streams

    base, src = tempfile.mkdtemp(prefix="ferrule-crash-"), tempfile.mkdtemp(prefix="ferrule-src-") + "/in"
    schema = spark.createDataFrame([], STATE).schema
    assert current_rows(spark, base, schema, "k", ["t"]).count() == 0
    go = lambda: run_live_state(spark.readStream.schema(schema).parquet(src), "k", ["t"], base)
    now = lambda: rows(current_rows(spark, base, schema, "k", ["t"]), ["k", "v"])
    put(spark, src, (1, 1, "a"), (2, 1, "b"))
    go()
    put(spark, src, (1, 2, "c"), (3, 1, "d"))
    real = streams.write_changed

    def killed(batch, batch_id, out):  # after its files are written
        real(batch, batch_id, out)
        raise RuntimeError("killed")

    monkeypatch.setattr(streams, "write_changed", killed)
    try:
        go()
    except Exception as e:
        assert "killed" in str(e)
    monkeypatch.setattr(streams, "write_changed", real)
    go()
    assert now() == [(1, "c"), (2, "b"), (3, "d")]
    put(spark, src, (1, 1, "late"), (2, 5, "e"))
    go()
    assert now() == [(1, "c"), (2, "e"), (3, "d")]
    batches = [spark.read.parquet(f).count() for f in sorted(glob.glob(f"{base}/out/batch=*"))]
    assert sum(batches) == 6  # each batch wrote the keys it touched, once


ACTIONS = "user_id long, event_id long, ts timestamp_ntz, mid long"


def test_sessions_end_by_logout_restart_or_timer_and_leave_no_state(spark):
    src, base = tempfile.mkdtemp(prefix="ferrule-ends-") + "/in", tempfile.mkdtemp(prefix="ferrule-ends-")
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    us = lambda s: int((at(s) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    files = [
        [(1, 1, at(0), 0), (2, 2, at(0), 0), (3, 3, at(5), None), (4, 4, at(9), 0)],
        [(1, 5, at(50), None), (2, 6, at(100), 0), (1, 7, at(60), 7)],  # logout; restart at the very limit; a message
        [(4, 8, at(500), None), (5, 9, at(500), 0)],  # long after the limit
        [(9, 10, at(9000), None)],  # moves the watermark past everything
        [(9, 11, at(9001), None)],
    ]
    schema = spark.createDataFrame([], ACTIONS).schema
    for f in files:
        spark.createDataFrame(f, ACTIONS).coalesce(1).write.mode("append").parquet(src)
        out, q = run_to_table(session_ends(spark.readStream.schema(schema).parquet(src), 100), base=base, wait=False)
        q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [(1, us(0), us(50), "logout"), (2, us(0), us(100), "restart"), (2, us(100), us(200), "expired"),
                   (4, us(9), us(109), "expired"), (5, us(500), us(600), "expired")]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_replies_are_correlated_on_session_and_message(spark):
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    asked = [[("a", "1", at(0)), ("a", "2", at(10)), ("b:x", "1", at(0))], [("a", "3", at(200)), ("c", "1", at(210))], [("z", "0", at(9000))], [("z", "9", at(9001))]]
    told = [[("a", "2", at(5), "before"), ("b:x", "1", at(119), "in time")],
            [("a", "1", at(60), "second"), ("a", "1", at(30), "first"), ("a", "2", at(131), "late"), ("c", "1", at(210), "at once")],
            [("a", "3", at(320), "at the limit"), ("z", "1", at(9000), "")], [("z", "2", at(9001), "")]]
    src, base = tempfile.mkdtemp(prefix="ferrule-join-"), tempfile.mkdtemp(prefix="ferrule-join-")
    q, r = "session string, mid string, req_ts timestamp", "session string, mid string, resp_ts timestamp, text string"
    for a, b in zip(asked, told):
        spark.createDataFrame(a, q).coalesce(1).write.mode("append").parquet(f"{src}/q")
        spark.createDataFrame(b, r).coalesce(1).write.mode("append").parquet(f"{src}/r")
        j = reply_join(spark.readStream.schema(q).parquet(f"{src}/q"), spark.readStream.schema(r).parquet(f"{src}/r"), ["session", "mid"], "req_ts", "resp_ts", 120, "3 minutes")
        out = run_to_table(j, base=base)
    got = sorted((x.session, x.mid, x.status, x.reply and x.reply.text) for x in spark.read.parquet(out).collect() if x.session != "z")
    assert got == [("a", "1", "matched", "first"), ("a", "2", "timeout", None), ("a", "3", "matched", "at the limit"),
                   ("b:x", "1", "matched", "in time"), ("c", "1", "matched", "at once")]


def test_message_ids_beyond_float64_are_kept(spark):
    src, big = tempfile.mkdtemp(prefix="ferrule-mid-") + "/in", 9007199254740993
    data = [(1, i, dt.datetime(2024, 1, 1, 0, i), mid, "t") for i, mid in enumerate([0, big, None, big + 2])]
    spark.createDataFrame(data, ACTIONS + ", title string").coalesce(1).write.parquet(src)
    out = run_to_table(session_turns(spark.readStream.schema(ACTIONS + ", title string").parquet(src)), name="t_mid")
    assert [r.mid for r in spark.read.parquet(out).orderBy("event_id").collect()] == [0, big, None, big + 2]


def test_streams_in_a_uri_folder(spark, monkeypatch):
    import ferrule.session

    q = E.queries()
    folder = "file:" + tempfile.mkdtemp(prefix="ferrule-uri-")
    monkeypatch.setattr(ferrule.session, "shared_dir", lambda s: folder)
    n = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert q["drain_once"](spark, SF_SMALL).count() == n
    bad = q["stream_quarantine"](spark, SF_SMALL).count()
    assert bad == q["quarantine"](spark, SF_SMALL).count() > 0
    assert rows(q["stream_current_state"](spark, SF_SMALL), ["user_id", "event_id"]) == rows(q["cdc_current_state"](spark, SF_SMALL), ["user_id", "event_id"])
    assert glob.glob(folder.removeprefix("file:") + "/ferrule/*/*")


def test_users_share_groups_of_state(spark):
    from ferrule.streaming.processors import KEYS

    src, base, big = tempfile.mkdtemp(prefix="ferrule-groups-") + "/in", tempfile.mkdtemp(prefix="ferrule-groups-"), 9007199254740993
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    users = [None, *range(big, big + 3 * KEYS)]
    files = [[(u, i, at(0), 0) for i, u in enumerate(users)], [(u, big + i, at(50), None) for i, u in enumerate(users) if i % 2 == 0],
             [(-1, -1, at(9000), None)], [(-1, -2, at(9001), None)]]
    schema, held = spark.createDataFrame([], ACTIONS).schema, []
    for f in files:
        spark.createDataFrame(f, ACTIONS).coalesce(1).write.mode("append").parquet(src)
        out, q = run_to_table(session_ends(spark.readStream.schema(schema).parquet(src), 100), base=base, wait=False)
        q.awaitTermination()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {r.user_id: (r.end_us - r.start_us, r.reason) for r in spark.read.parquet(out).collect()}
    assert got == {u: (50_000_000, "logout") if i % 2 == 0 else (100_000_000, "expired") for i, u in enumerate(users)}
    assert held[0] <= KEYS and held[-1] == 0


def test_correlation_of_users_that_share_groups(spark):
    from ferrule.streaming.processors import KEYS

    src, base, big = tempfile.mkdtemp(prefix="ferrule-corr-") + "/in", tempfile.mkdtemp(prefix="ferrule-corr-"), 9007199254740993
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    users, schema, held = [None, *range(big, big + 3 * KEYS)], "user_id long, id long, ts timestamp_ntz, kind int", []
    files = [[(u, big + i, at(0), 0) for i, u in enumerate(users)], [(u, -i, at(50 + i % 100), 1) for i, u in enumerate(users) if i % 2 == 0],
             [(-1, -1, at(9000), 1)], [(-1, -2, at(9001), 1)]]
    files[0] += [(7, 1, None, 0), (8, 3, at(0), 0)]  # a row without a time matches none with one
    files[1] += [(7, 2, None, 1), (7, 5, at(60), 1), (8, 6, None, 1)]
    for f in files:
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(src)
        out, q = run_to_table(correlate_stream(spark.readStream.schema(schema).parquet(src), 100), base=base, wait=False)
        q.awaitTermination()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = {(r.user_id, r.event_id): (r.resp_event_id, r.status) for r in spark.read.parquet(out).collect()}
    alone = {(7, 1): (None, "timeout"), (8, 3): (None, "timeout")}
    assert got == alone | {(u, big + i): (-i, "matched") if i % 2 == 0 and i % 100 <= 50 else (None, "timeout") for i, u in enumerate(users)}
    assert held[0] <= KEYS


def test_staged_sets_of_files_are_batches_in_order(spark):
    from ferrule.streaming.runner import read_staged, staged

    df = spark.range(3000).withColumnRenamed("id", "n")
    path, files = staged(spark, df, "n", file_rows=250)
    assert files == 4 and len(glob.glob(f"{path}/*.parquet")) == 12
    seen = []
    run_to_table(read_staged(spark, path, df.schema, files), name="t_sets", foreach_batch=lambda b, i, o: seen.append(tuple(b.agg(F.min("n"), F.max("n")).first())))
    assert seen == [(0, 999), (1000, 1999), (2000, 2999)]
    assert staged(spark, df.where("n < 2100"), "n", file_rows=800)[1] == 1


def test_a_retrieval_turn_finds_its_texts_whatever_tasks_the_search_has(spark, tmp_path):
    from ferrule.functions.embed import with_vector
    from ferrule.streaming.streams import rag_turn_step

    said = [(i, f"t{i}", f"alpha{i} beta{i} gamma{i}") for i in range(300)]
    texts = spark.createDataFrame(said, "id long, title string, description string").repartition(3)
    corpus = with_vector(texts, "description", 384).select("id", "title", "vector")
    step = rag_turn_step(corpus, 1, 0.9, ["conv_id"], "turn", texts=texts, n_corpus=300)
    batch = lambda *turns: spark.createDataFrame([(f"{c}:{t}", c, t, said[n][2]) for c, t, n in turns], "qid string, conv_id long, turn long, query string")
    stored = len(spark.sparkContext._jsc.getPersistentRDDs())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        step(batch((1, 0, 7), (2, 0, 8), (3, 0, 9)), 0, str(tmp_path))
        for _ in range(2):  # the second time as after a failure
            step(batch((1, 1, 7), (1, 2, 8), (2, 1, 299)), 1, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = rows(spark.read.parquet(f"{tmp_path}/ctx").selectExpr("conv_id", "turn", "coalesce(split(context, '- ')[1], '') AS item"))
    item = lambda n: f"t{n}: {said[n][2]}"
    assert got == [(1, 0, item(7)), (1, 1, ""), (1, 2, item(8)), (2, 0, item(8)), (2, 1, item(299)), (3, 0, item(9))]
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == stored
