"""Registered queries against their SQL over the smallest tables."""

import duckdb
import pytest

from lexmill.plans import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(q.QUERIES) == set(q.ORACLE) | {"page_blocks"}


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query(spark, con, name):
    got = q.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({q.ORACLE[name]})").fetchall()
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert rows
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
