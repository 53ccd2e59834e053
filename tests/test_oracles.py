"""Every query with SQL gives what DuckDB gives, and the others give rows of a stable shape."""

import math

import duckdb
import pytest

from graphloom.plans import catalog  # noqa: F401
from graphloom.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def plain(rows):
    fix = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else repr(x)
    return sorted(tuple(str(fix(x)) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, data, con, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: KINDS.get(k, k) for c, k in df.dtypes} == kinds
    order = [rel.columns.index(c) for c in cols]
    assert plain(tuple(r) for r in df.select(*cols).collect()) == plain(tuple(r[i] for i in order) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
