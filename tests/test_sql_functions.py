"""The functions as a SQL user calls them."""

import json

from ferrule.functions.sql import hashing_model, register


def test_functions_in_sql(spark):
    register(spark)
    got = spark.sql("""SELECT hash_md5(t) AS h, get_vector_data(t) AS v FROM VALUES ('pets'), (''), (CAST(NULL AS STRING)) AS x(t)""").collect()
    assert [r.h for r in got] == ["d0d64110-d956-3247-dad8-35d349e9b507", "d41d8cd9-8f00-b204-e980-0998ecf8427e", None]
    vector = json.loads(got[0].v)
    assert vector["vector_data"] == hashing_model()()(["pets"])[0].tolist() and len(vector["vector_data"]) == 384
    assert (vector["status_code"], vector["error"]) == (200, False) and "message" not in vector
    assert set(json.loads(got[1].v)["vector_data"]) == {0.0} and got[2].v == ""


def test_a_text_that_cannot_be_embedded_is_told_in_its_row(spark):
    def model():
        def encode(texts):
            if "bad" in texts:
                raise ValueError("cannot embed")
            return [[float(len(t))] for t in texts]

        return encode

    register(spark, model)
    got = spark.sql("SELECT t, get_vector_data(t) AS v FROM VALUES ('bad'), ('good') AS x(t)").collect()
    assert {r.t: json.loads(r.v) for r in got} == {
        "bad": {"status_code": 500, "error": True, "message": "ValueError: cannot embed"},
        "good": {"vector_data": [4.0], "status_code": 200, "error": False}}
    register(spark)


def test_terms_as_a_table_function(spark):
    register(spark)
    got = spark.sql("""SELECT id, sum(tf) AS n, count(*) AS b FROM VALUES (1, 'a b a'), (2, ''), (3, CAST(NULL AS STRING)) AS x(id, t),
                       LATERAL hashed_terms(t, 1000000) GROUP BY id""").collect()
    assert [tuple(r) for r in got] == [(1, 3, 2)]
