"""The library's functions in SQL: ``register(spark)`` defines them for a session.

* ``hash_md5(text)``: MD5 in UUID layout, a SQL function over built-in ones (null stays null);
* ``get_vector_data(text)``: the text's vector as JSON text, ``{"vector_data": [...], "status_code": 200, "error": false}``;
  null gives ``''``, a text that cannot be embedded ``{"status_code": 500, "error": true, "message": ...}`` and no failure;
* ``hashed_terms(text, dim)``: a table function, one row ``bucket, tf`` per non-empty bucket of the hashing embedder, for
  ``LATERAL`` joins; a null text or one without tokens has no rows.

``get_vector_data`` embeds Arrow batches with the given model, by default the hashing embedder."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .embed import TOKEN, model_results

_UUID = "regexp_replace(md5(x), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5')"


def hashing_model(dim: int = 384) -> Callable:
    """The hashing embedder as a model loader: unit vectors, zeros for a text without tokens."""

    def load():
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for row, t in zip(out, texts):
                for token, n in Counter(re.findall(TOKEN, t.lower())).items():
                    row[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim] += n
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norm > 0, norm, 1)

        return encode

    return load


@udtf(returnType="bucket int, tf bigint")
class HashedTerms:
    def eval(self, text: str, dim: int):
        total: Counter = Counter()
        for token, n in Counter(re.findall(TOKEN, (text or "").lower())).items():
            total[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim] += n
        yield from sorted(total.items())


def register(spark: SparkSession, load_model: Callable | None = None, dim: int = 384) -> None:
    """Define the functions for the session's SQL; a second call replaces them."""
    spark.udf.register("embed_result", model_results(load_model or hashing_model(dim)))
    spark.udtf.register("hashed_terms", HashedTerms)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION hash_md5(x STRING) RETURNS STRING RETURN {_UUID}")
    told = "named_struct('vector_data', r.vector, 'status_code', r.status_code, 'error', r.error, 'message', r.message)"
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION get_vector_data(x STRING) RETURNS STRING RETURN "
              f"CASE WHEN x IS NULL THEN '' ELSE transform(array(embed_result(x)), r -> to_json({told}))[0] END")
