"""Every core query runs, and equals its SQL where it has one."""

import os
from collections import Counter

import duckdb
import pytest

from quillstone.plans import registry

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def _norm(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, DIR)
    cursor = db.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(_norm(r[columns.index(c)]) for c in sorted(columns)) for r in cursor.fetchall())
    assert Counter(tuple(_norm(r[c]) for c in sorted(columns)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() >= 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and {"source_label", "predicate", "target_label"} <= set(df.columns)
