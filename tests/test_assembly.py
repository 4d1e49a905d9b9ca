"""Listing / prompt / small relational helpers on the FIXTURES edge rows."""

import datetime as dt

from pyspark.sql import functions as F

from ferrule.operators.misc import attach_context, categorise, label, sentinel, zip_pair
from ferrule.operators.prompt import attribute_list, fold_lines, sectioned_listing
from ferrule.operators.replies import purge_prefix
from ferrule.sources.seed import insert_new
from ferrule.sources.vector_store import to_points
from ferrule.streaming.processors import session_machine
from tests.conftest import rows

ITEMS = "id long, section string, name string, descr string, size int, price float"


def test_listing_empty_and_unknown_sections(spark):
    items = spark.createDataFrame(
        [(1, "mains", "red_wine", "x", None, 6.0), (2, "mains", "chef's-pie", "y", 2, 1.5), (3, "secret", "z", "z", 1, 1.0)], ITEMS
    )
    lines = sectioned_listing(items, ["starters", "mains"], 4, section_col="section", name_col="name", descr_col="descr",
                              attr_cols=["size", "price"], order=["id"])
    got = [r["text"] for r in lines.orderBy("section_no", "item_no").collect()]
    assert got == [
        "4.1 Starters:",
        "4.2 Mains:",
        "4.2.1 Red Wine (x): Size None, Price 6.0",
        "4.2.2 Chef'S Pie (y): Size 2, Price 1.5",
    ]


def test_attribute_list_and_labels(spark):
    df = spark.createDataFrame([(None, 6.0, "F", -1)], "a int, b double, s string, t int")
    r = df.select(attribute_list(["s", "t"], df.columns).alias("x"), label("s", {"F": "Done"}, "?").alias("l"),
                  sentinel("t").alias("n"), categorise(F.lit("zzz"), {"a": "b"}, "restaurant").alias("c")).first()
    assert (r["x"], r["l"], r["n"], r["c"]) == ("A None, B 6.0", "Done", "N/A", "restaurant")


def test_fold_lines_in_chunks(spark):
    lines = spark.createDataFrame([(1, i, f"l{i}") for i in range(5)], "g int, n int, text string")
    got = rows(fold_lines(lines, ["g"], ["n"], chunk_col="n", chunk=2), ["chunk", "n_lines", "text"])
    assert got == [(0, 2, "l0\nl1"), (1, 2, "l2\nl3"), (2, 1, "l4")]


def test_novelty_again_after_restart(spark):
    t0 = dt.datetime(2024, 1, 1)
    import pandas as pd

    pdf = pd.DataFrame({
        "user_id": [1] * 5,
        "event_id": [1, 2, 3, 4, 5],
        "ts": [t0 + dt.timedelta(seconds=i) for i in range(5)],
        "mid": [0, 10, 11, 0, 12],
        "title": [None, "a", "a", None, "a"],
        "logout": [False] * 5,
    })

    class State:
        exists = False
        def update(self, v):  # noqa: E301
            self.v = v
        def remove(self):  # noqa: E301
            pass

    out = next(session_machine((1,), iter([pdf]), State()))
    novel = [None if pd.isna(v) else bool(v) for v in out["novel"].tolist()]
    assert novel[1:3] == [True, False]  # same title twice in an epoch: once, no refill
    assert novel[4] is True  # given again after mid=0 (a new epoch)


def test_soft_delete_point_and_helpers(spark):
    ch = spark.createDataFrame([("k1", "hello world", "c"), ("k2", "bye", "d")], "key string, text string, op string")
    pts = {r["title"]: r for r in to_points(ch, "key", "text", dim=16).collect()}
    assert pts[""]["description"] == "" and pts[""]["vector"] is None  # delete: blank payload, id kept
    assert pts["k1"]["embed_text"] == "k1: hello world" and pts["k1"]["vector"] is not None

    reg = spark.createDataFrame([(1, "a")], "k int, v string")
    assert rows(insert_new(reg, spark.createDataFrame([(1, "x"), (2, "b")], "k int, v string"), ["k"])) == [(1, "a"), (2, "b")]

    cache = spark.createDataFrame([("s1:5",), ("s10:5",), ("s2:None",)], "reply_key string")
    gone = spark.createDataFrame([("s1",)], "sid string")
    assert rows(purge_prefix(cache, gone, "reply_key", "sid", ":")) == [("s10:5",), ("s2:None",)]
    assert rows(purge_prefix(cache, gone, "reply_key", "sid")) == [("s2:None",)]  # a plain prefix
    odd = spark.createDataFrame([("a:b:1",), ("a:bc:1",), ("a:1",), ("é:x:1",), (None,)], "reply_key string")
    ids = spark.createDataFrame([("a:b",), ("é:x",), ("a:b",), (None,), ("a:b:1:long",)], "sid string")
    left = [r[0] for r in purge_prefix(odd, ids, "reply_key", "sid", ":").collect()]
    assert len(left) == 3 and set(left) == {None, "a:1", "a:bc:1"}
    assert purge_prefix(odd, ids.limit(0), "reply_key", "sid").count() == 5

    a = spark.createDataFrame([(1, ["x", "y", "z"])], "id int, l array<string>")
    b = spark.createDataFrame([(1, ["p", "q"])], "id int, m array<string>")
    assert rows(zip_pair(a, b, "id", "l", "m"), ["pos", "a", "b"]) == [(0, "x", "p"), (1, "y", "q")]

    ctx = spark.createDataFrame([("shared",)], "c string")
    assert rows(attach_context(spark.createDataFrame([(1,), (2,)], "s int"), ctx)) == [(1, "shared"), (2, "shared")]
