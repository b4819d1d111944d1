import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, plain

QUERIES, ORACLE = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, data, duck):
    got = QUERIES[name](spark, data).toPandas()
    if name in ORACLE:
        want = duck.sql(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got) > 0


def test_entry(spark, data):
    assert entry(spark).count() == 1


def test_names():
    assert set(ORACLE) <= set(QUERIES)
