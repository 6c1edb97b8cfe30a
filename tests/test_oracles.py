"""Every registered query against its SQL on the smallest tables."""

import decimal
import glob
import os

import duckdb
import numpy as np
import pytest

from vinctum import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if isinstance(v, (float, np.floating)):
        return None if v != v else round(float(v), 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm(x) for x in v)
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def compare(spark, con, query, sql):
    df = query(spark, SF)
    cols = sorted(df.columns)
    mine = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = sorted(repr([norm(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    compare(spark, con, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0


def test_entry_and_registry():
    import __spark_entry__ as e

    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
