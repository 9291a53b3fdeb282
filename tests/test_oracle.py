"""Every registered query against its DuckDB oracle on sf0.001 (rows-only
queries: they must run and return rows)."""

import math

import duckdb
import pytest

from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    import numpy as np
    import pandas as pd
    if v is None or v is pd.NA:
        return None
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else round(float(v), 9)
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def _spark_type(dt) -> str:
    from pyspark.sql import types as T
    if isinstance(dt, T.ArrayType):
        return _spark_type(dt.elementType) + "[]"
    if isinstance(dt, T.StructType):
        return "STRUCT(" + ", ".join(f"{f.name.upper()} {_spark_type(f.dataType)}" for f in dt.fields) + ")"
    return {"LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE", "FloatType": "FLOAT",
            "StringType": "VARCHAR", "BooleanType": "BOOLEAN"}.get(type(dt).__name__, type(dt).__name__)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)),
                        key=repr)


def _names():
    from prefspark.plans.registry import QUERIES, load_all
    load_all()
    return sorted(QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    from __spark_entry__ import oracle_sql, queries
    df = queries()[name](spark, SF_SMALL)
    got = df.toPandas()
    sql = oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    rel = duck.sql(sql)
    want_types = {c: str(t).upper().replace('"', "") for c, t in zip(rel.columns, rel.types)}
    want = rel.fetchdf()
    assert _rows(got) == _rows(want)
    got_types = {f.name: _spark_type(f.dataType) for f in df.schema.fields}
    assert got_types == want_types


def test_every_query_has_an_oracle():
    from prefspark.plans.registry import ORACLE
    assert set(_names()) == set(ORACLE)


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["metric", "mean", "std"]
    assert df.count() > 0
