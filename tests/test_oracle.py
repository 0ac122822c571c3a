"""Every registered query against its DuckDB oracle at sf0.001."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SQL = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if v is None or v is pd.NA:
        return "null"
    if isinstance(v, float):
        if math.isnan(v):
            return "null"
        if v.is_integer() and abs(v) < 2 ** 53:
            return str(int(v))
        return f"{round(v, 6):.6f}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    got = pd.DataFrame(sdf.collect(), columns=sdf.columns)
    exp = con.execute(SQL[name]).fetchdf()
    assert _rows(got) == _rows(exp)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_return_rows_and_agree_on_a_rerun(spark, name):
    """Their values are checked by brute force or goldens in their own tests."""
    once, again = (QUERIES[name](spark, SF_SMALL).toPandas() for _ in range(2))
    assert len(once) > 0
    assert _rows(once) == _rows(again)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["seg_id", "hyp", "ref", "ratio"]
