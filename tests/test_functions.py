"""Scalar functions on the hand-written edge rows of FIXTURES.md."""

import datetime as dt

from pyspark.sql import functions as F

from ferrule.functions import html as H
from ferrule.functions import text as X
from ferrule.functions.json import json_annotate, json_vector, payload_kind
from ferrule.functions.logs import log_app, log_level, log_markup, parse_log


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first()["y"]


def test_md5_uuid(spark):
    assert one(spark, X.md5_uuid("x"), "pets") == "d0d64110-d956-3247-dad8-35d349e9b507"
    assert one(spark, X.md5_uuid("x"), None) is None


def test_title_case(spark):
    assert one(spark, X.title_case("x"), "red_wine (125 ml)") == "Red Wine (125 Ml)"
    assert one(spark, X.title_case("x"), "chef's") == "Chef'S"
    assert one(spark, X.title_case("x"), "5pm") == "5Pm"
    assert one(spark, X.title_case("x"), "(q)") == "(Q)"


def test_title_case_matches_python(spark):
    import random

    random.seed(3)
    alphabet = "abcXYZ éÉ_-'5 (9)ñ"  # no 'ß': Python title-cases it to 'Ss', Java upper-cases to 'SS"
    words = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "x string")
    got = [r["y"] for r in df.select(X.title_case("x", spaces=False).alias("y")).collect()]
    assert got == [w.title() for w in words]


def test_age_years(spark):
    born = dt.date(2004, 2, 29)
    df = spark.createDataFrame(
        [(born, dt.date(2023, 2, 28)), (born, dt.date(2024, 2, 28)), (born, dt.date(2024, 2, 29))], "b date, a date"
    )
    assert [r[0] for r in df.select(X.age_years("b", "a")).collect()] == [19, 19, 20]


def test_epoch_day_format(spark):
    assert one(spark, X.epoch_day_format("x"), 2252, "x int") == "1976/03/02"


def test_default_if_empty(spark):
    assert one(spark, X.default_if_empty("x", "d"), None) == "d"
    assert one(spark, X.default_if_empty("x", "d"), "") == "d"
    assert one(spark, X.default_if_empty("x", "d"), " ") == " "


def test_flatten_ws_and_split(spark):
    assert one(spark, X.flatten_ws("x"), "a\r\n\tb   c") == "a b c"
    assert one(spark, X.split_statements("x", ";"), "a; ;b") == ["a;", "b;"]


def test_substitute_vars(spark):
    e = X.substitute_vars("x", {"A": "1", "AB": "2"})
    assert one(spark, e, "$ENV.A $ENV.AB") == "1 2"
    # '-' belongs to a name: "A-" is an unknown placeholder, like the original
    assert one(spark, e, "$ENV.A-$ENV.AB $ENV.Z.") == "2 ."
    assert one(spark, X.placeholders("x"), "$ENV.A $ENV.AB $ENV.A") == ["A", "AB"]


def test_log_parse(spark):
    df = spark.createDataFrame([("[web] 2024-01-01 00:00:00,000.000 [INFO]: hi",), ("[a][b] no level",), ("plain",)], "value string")
    got = parse_log(df).select("app", "level", "message").collect()
    assert tuple(got[0]) == ("web", "INFO", "hi")
    assert tuple(got[1])[:2] == ("a", "")
    assert tuple(got[2])[:2] == ("", "")
    assert one(spark, log_markup(F.col("x")), "[web] t [INFO]: a\nb") == (
        "<div class='log-web'><b>[web]</b> t <b>[INFO]</b><br>a<br>b</div>"
    )


def test_clean_reply(spark):
    assert one(spark, X.clean_reply("x"), "<a>\n<b>") == "<a><b>"
    assert one(spark, X.clean_reply("x"), "  x\n\n\ny \n") == "x<br>y"


def test_strip_fences(spark):
    assert one(spark, H.strip_fences("x"), "```html\n<p>a</p>\n```") == "\n<p>a</p>\n"
    assert one(spark, H.strip_fences("x"), "```json{}``` x") == "{} x"


def test_html_scan_leaves_what_is_no_tag(spark):
    keep = """<!-- <h1>no</h1> <p> --><script>var t="</p><h2>";</script><STYLE>h1{}</STYLE ><img alt="<h3> class=x <p>" title='>'>a < b <"""
    assert one(spark, H.html_headings("x"), keep + "<h1 a='<h2>'>t</h1><h1x><hr>") == keep + "<h6 a='<h2>'>t</h6><h1x><hr>"
    assert one(spark, H.html_set_class("x", "p", "c"), keep + "<p-x><pre><p>") == keep + '<p-x><pre><p class="c">'
    got = one(spark, H.html_set_class("x", "p", "c"), """<P data-x='class="k"' CLASS = old id=i hidden><p class/><p\nclass="a>b" title="class=z">""")
    assert got == """<P class="c" data-x='class="k"' id=i hidden><p class="c"/><p class="c" title="class=z">"""
    for broken in ("<h1", "<!-- <h1>", '<p class="x', "<script><h1>", "", "<<h1>>"):
        tokens = one(spark, H.html_tokens("x"), broken)
        assert "".join(tokens) == broken
    assert one(spark, H.html_headings("x"), "<!-- open <h1>") == "<!-- open <h6>"
    deep = "<p " + "a='b' " * 20000 + ">"
    assert one(spark, H.html_set_class("x", "p", "c"), deep + "<!--" + "x" * 100000 + "-->").startswith('<p class="c" a=')


def test_html_rewrites(spark):
    assert one(spark, H.html_headings("x"), "<H2 id=a>t</h2><h6>s</h6><hr>") == "<h6 id=a>t</h6><h6>s</h6><hr>"
    got = one(spark, H.html_set_class("x", "p", "c1 c2"), "<p class='old'>a</p><pre>b</pre><P>c</P>")
    assert got == '<p class="c1 c2">a</p><pre>b</pre><P class="c1 c2">c</P>'


def test_json_vector(spark):
    assert one(spark, json_vector("x"), '{"vector_data": [1,2.5e-33]}') == [1.0, 2.5e-33]
    assert one(spark, json_vector("x"), '{"other": 1}') is None


def test_json_annotate_keeps_every_field(spark):
    data = [('{"b":{"x":[1,null]},"a":1.5,"error":"old","q\\"k.":"s\\"t","status_code":7,"n":null}',), ("{}",), ("[1]",), ("nope",), (None,)]
    df = spark.createDataFrame(data, "x string")
    got = [r[0] for r in df.select(json_annotate("x", None, F.lit(500))).collect()]
    only = '{"status_code":500,"error":true}'
    assert got == ['{"b":{"x":[1,null]},"a":1.5,"q\\"k.":"s\\"t","n":null,"status_code":500,"error":true}', only, only, only, only]


def test_json_annotate_and_kind(spark):
    df = spark.createDataFrame([('{"k": 5}', 500)], "x string, c int")
    assert df.select(json_annotate("x", [("k", "bigint")], F.col("c"))).first()[0] == '{"k":5,"status_code":500,"error":true}'
    kinds = spark.createDataFrame([(None,), ('{"a":1}',), ("text",), ("[1]",)], "x string").select(payload_kind("x")).collect()
    assert [k[0] for k in kinds] == ["tombstone", "json", "text", "text"]


def test_reply_key_and_tokens(spark):
    df = spark.createDataFrame([("s1", None), ("s1", 5)], "s string, m long")
    assert [r[0] for r in df.select(X.reply_key("s", "m")).collect()] == ["s1:None", "s1:5"]
    assert one(spark, X.whitespace_tokens("x"), " a b\tc ") == 3
    assert one(spark, X.whitespace_tokens("x"), "") == 0
