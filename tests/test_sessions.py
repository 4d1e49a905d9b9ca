"""Session state, correlation and numbering with hot keys."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ferrule.operators.replies import correlate
from ferrule.operators.scan import grouped_scan
from ferrule.operators.sessions import orphan_turns, session_state
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_session_edges(spark):
    acts = spark.createDataFrame(
        [
            (1, "u", at(0), 5),  # message before start -> error
            (2, "u", at(1), 0),  # start
            (3, "u", at(2), 6),  # ok
            (4, "u", at(3), None),  # logout
            (5, "u", at(4), 7),  # message after logout -> error
        ],
        "event_id long, user_id string, ts timestamp, mid long",
    )
    st = session_state(acts, "user_id", ["ts", "event_id"], "ts")
    assert rows(st, ["event_id", "epoch", "started"]) == [(1, 0, False), (2, 1, True), (3, 1, True), (4, 1, False), (5, 1, False)]
    orph = orphan_turns(st)
    assert rows(orph, ["event_id", "total_tokens"]) == [(1, -1), (5, -1)]


def test_correlate_limit_and_one_result(spark):
    req = spark.createDataFrame([("s", 1, at(0)), ("s", 2, at(1000))], "sid string, rid long, ts timestamp")
    resp = spark.createDataFrame(
        [("s", 10, T0 + dt.timedelta(seconds=119.9)), ("s", 11, at(119.95)), ("s", 12, at(1120.1))],
        "sid string, pid long, pts timestamp",
    )
    out = {r["rid"]: (r["pid"], r["status"]) for r in correlate(req, resp, ["sid"], "rid", "ts", "pid", "pts", 120).collect()}
    assert out[1] == (10, "matched")  # 119.9 s matched; two replies -> the first only
    assert out[2] == (None, "timeout")  # 120.1 s -> timeout


def test_grouped_scan_hot_key(spark):
    # one key holds far more than a third of the rows
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"), F.col("id"), (F.col("id") % 7).alias("v")
    )
    g = grouped_scan(df, ["k"], ["id"], number="rn", sums={"run": F.col("v")}, maxes={"mx": F.col("v")}, slices=8)
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("k", "id", F.row_number().over(Window.partitionBy("k").orderBy("id")).alias("rn"),
                    F.sum("v").over(w).alias("run"), F.max("v").over(w).alias("mx"))
    assert rows(g, ["k", "id", "rn", "run", "mx"]) == rows(ref, ["k", "id", "rn", "run", "mx"])


def test_hot_key_spans_several_ranges(spark):
    from ferrule.operators.scan import dealt_ranges

    df = spark.range(0, 6000).select(F.when(F.col("id") % 3 != 0, F.lit(0)).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("o"))
    hot = dealt_ranges(df, ["k"], ["o"], 8).where("k = 0").select("_slice").distinct().count()
    assert hot >= 4  # the key with two thirds of the rows is cut into several ranges


def test_grouped_scan_many_ranges_nulls_and_ties(spark):
    """Over 2,000 ranges; a null group, null values, and running values that begin with nulls."""
    df = spark.range(0, 6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 50).alias("k"), (F.col("id") % 100).alias("t"), "id",
        F.when((F.col("id") > 2000) & (F.col("id") % 7 == 0), F.col("id")).alias("v"))
    g = grouped_scan(df, ["k"], ["t", "id"], number="rn", sums={"run": F.col("v")}, maxes={"mx": F.col("v")}, slices=2100)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("k", "id", F.count(F.lit(1)).over(w).alias("rn"), F.sum("v").over(w).alias("run"), F.max("v").over(w).alias("mx"))
    key = lambda r: tuple((x is not None, x) for x in r)
    cols = ["k", "id", "rn", "run", "mx"]
    assert sorted((tuple(r) for r in g.select(*cols).collect()), key=key) == sorted((tuple(r) for r in ref.select(*cols).collect()), key=key)


def test_start_and_logout_at_one_instant(spark):
    acts = spark.createDataFrame([(1, "u", at(0), 0), (2, "u", at(1), None), (3, "u", at(1), 0), (4, "u", at(1), 7), (5, None, at(0), 0), (6, None, at(0), 9)],
                                 "event_id long, user_id string, ts timestamp, mid long")
    st = session_state(acts, "user_id", ["ts", "event_id"], "ts")
    assert rows(st, ["event_id", "started"]) == [(1, True), (2, False), (3, True), (4, True), (5, True), (6, True)]


def test_correlate_hot_key_sliced_equals_brute_force(spark):
    import random

    random.seed(5)
    # one hot session with most of the traffic, a few cold ones
    reqs = [("hot" if i % 4 else f"c{i % 7}", i, at(random.randint(0, 5000))) for i in range(400)]
    resps = [("hot" if i % 4 else f"c{i % 7}", 10_000 + i, at(random.randint(0, 5200))) for i in range(300)]
    rq = spark.createDataFrame(reqs, "sid string, rid long, ts timestamp")
    rs = spark.createDataFrame(resps, "sid string, pid long, pts timestamp")
    got = {r["rid"]: r["pid"] for r in correlate(rq, rs, ["sid"], "rid", "ts", "pid", "pts", 120, slices=6).collect()}
    for sid, rid, t in reqs:
        cands = sorted((pt, pid) for s2, pid, pt in resps if s2 == sid and t <= pt <= t + dt.timedelta(seconds=120))
        assert got[rid] == (cands[0][1] if cands else None)
