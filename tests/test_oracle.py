"""Every registered query against its DuckDB twin at sf0.001 (the same
check the driver runs at sf0.01)."""

import math

import pandas as pd
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

ORACLE = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for _, r in df[cols].iterrows()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    s = QUERIES[name](spark, SF_SMALL).toPandas()
    o = duck.execute(ORACLE[name]).df()
    assert _rows(s) == _rows(o)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() >= 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["conv_id", "turn", "context", "n_items"]
    assert df.count() > 0


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
          "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_column_types_match_oracle(spark, duck, name):
    s = QUERIES[name](spark, SF_SMALL).schema
    got = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in s.fields}
    rel = duck.sql(ORACLE[name])
    assert got == dict(zip(rel.columns, [str(t) for t in rel.types]))
