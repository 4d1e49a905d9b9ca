"""Change-log folds on the FIXTURES edge rows."""

from pyspark.sql import functions as F

from ferrule.operators.cdc import current_state, orphan_deletes, state_order, unwrap_changes
from ferrule.operators.quality import split_bad
from tests.conftest import rows

ROW = "struct<id:string, title:string>"
SCHEMA = f"seq long, op string, before {ROW}, after {ROW}"


def env(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_c_u_d_c_keeps_last_c_and_its_place(spark):
    data = [
        (1, "c", None, ("k", "a")),
        (2, "c", None, ("j", "x")),
        (3, "u", None, ("k", "b")),
        (4, "d", ("k", "b"), None),
        (5, "c", None, ("k", "z")),
        (6, "u", None, ("j", "y")),
    ]
    ch = unwrap_changes(env(spark, data), key="id", keep=["seq"]).drop("bad")
    st = state_order(ch, "id", ["seq"], payload=["title"])
    got = rows(st, ["id", "title", "first_seq"])
    assert got == [("j", "y", 2), ("k", "z", 5)]  # j keeps its place, k moved to the end


def test_unknown_delete_and_upsert_without_create(spark):
    data = [(1, "d", ("ghost", "g"), None), (2, "u", None, ("k", "b"))]
    ch = unwrap_changes(env(spark, data), key="id", keep=["seq"]).drop("bad")
    assert rows(current_state(ch, "id", ["seq"], payload=["title"]), ["id", "title"]) == [("k", "b")]
    assert rows(orphan_deletes(ch, "id", ["seq"]), ["id"]) == [("ghost",)]


def test_snapshot_op_r_modes(spark):
    data = [(1, "r", None, ("k", "a"))]
    sql = unwrap_changes(env(spark, data), key="id", mode="sql").first()
    assert (sql["id"], sql["bad"]) == ("k", False)
    cons = unwrap_changes(env(spark, data), key="id", mode="consumer")
    good, bad = split_bad(cons, {"payload": ~F.col("bad")})
    assert good.count() == 0 and bad.count() == 1


def test_soft_delete_blanks_payload(spark):
    data = [(1, "c", None, ("k", "a")), (2, "d", ("k", "a"), None)]
    ch = unwrap_changes(env(spark, data), key="id", keep=["seq"]).drop("bad")
    soft = current_state(ch, "id", ["seq"], deletes="soft", payload=["title"]).first()
    assert (soft["id"], soft["title"], soft["deleted"]) == ("k", "", True)
    assert current_state(ch, "id", ["seq"], deletes="hard", payload=["title"]).count() == 0


def test_replay_is_idempotent(spark):
    data = [(1, "c", None, ("k", "a")), (2, "u", None, ("k", "b")), (3, "c", None, ("m", "c"))]
    ch = unwrap_changes(env(spark, data), key="id", keep=["seq"]).drop("bad")
    once = rows(current_state(ch, "id", ["seq"], payload=["title"]))
    twice = rows(current_state(ch.unionByName(ch), "id", ["seq"], payload=["title"]))
    assert once == twice
