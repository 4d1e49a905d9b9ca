"""JSON helpers: vector fields, annotations, payload routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def json_vector(x, path: str = "$.vector_data") -> Column:
    """JSON field -> list -> array<double>; a missing field gives null."""
    items = F.from_json(F.get_json_object(_c(x), path), "array<string>")
    return F.transform(items, lambda v: v.cast("double"))


def json_annotate(x, fields: list[tuple[str, str]] | None, status_code) -> Column:
    """Add ``status_code`` and ``error`` (= code != 200) to a JSON object.

    Without ``fields`` every field of the object is kept as it is, in its order, but for earlier fields of those two names;
    null and what is no JSON object give an object of the two fields alone.  With ``fields``, the object's schema as (name,
    type) pairs, exactly those are kept, cast to their types, null where missing.
    """
    code = _c(status_code)
    if fields is None:
        own = F.map_filter(F.from_json(_c(x), "map<string,variant>"), lambda k, v: ~k.isin("status_code", "error"))
        text = F.coalesce(F.to_json(own), F.lit("{}"))
        rest = F.concat(F.lit('"status_code":'), code.cast("string"), F.lit(',"error":'), (code != F.lit(200)).cast("string"), F.lit("}"))
        return F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.when(text != "{}", F.lit(",")).otherwise(F.lit("")), rest)
    schema = ", ".join(f"{n} {t}" for n, t in fields)
    parsed = F.from_json(_c(x), schema)
    return F.to_json(
        F.struct(
            *[parsed[n].alias(n) for n, _ in fields],
            code.alias("status_code"),
            (code != F.lit(200)).alias("error"),
        ),
        {"ignoreNullFields": "false"},
    )


def payload_kind(x) -> Column:
    """null -> tombstone; a JSON object -> json; anything else -> text."""
    c = _c(x)
    return (
        F.when(c.isNull(), F.lit("tombstone"))
        .when(F.try_parse_json(c).isNotNull() & F.ltrim(c).startswith("{"), F.lit("json"))
        .otherwise(F.lit("text"))
    )

