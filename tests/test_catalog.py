"""Every query of the library against DuckDB, or for rows where SQL can't say it."""

import datetime
import decimal

import duckdb
import pytest

from gridloom import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, float):
        return repr(value + 0.0)
    return repr(value if not isinstance(value, datetime.datetime) else value.replace(tzinfo=None))


def table(names, rows):
    order = [names.index(n) for n in sorted(names)]
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    rows = [tuple(r) for r in df.collect()]
    sql = catalog.oracles().get(name)
    if sql is None:
        assert rows
        return
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert table(df.columns, rows) == table(names, want.fetchall())
