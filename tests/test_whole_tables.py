"""Queries over whole tables, against DuckDB on a table of several ranges."""

import duckdb
import pytest

from gridloom import catalog
from gridloom.operators import aggregates

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["running_product", "group_by_product", "xlookup_text_first_match"])
def test_all_rows(spark, name):
    duck = duckdb.connect()
    for t in ("events", "lineitem"):
        duck.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    sql = catalog.oracles()[name]
    assert " < " not in sql
    df = catalog.queries()[name](spark, DIR)
    want = duck.execute(sql)
    at = [df.columns.index(d[0]) for d in want.description]
    assert sorted(tuple(r[i] for i in at) for r in df.collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("name", ["group_by_geomean", "group_by_harmean"])
def test_zeros(spark, tmp_path, name):
    """Groups with a zero among their numbers, with none, and with no number."""
    rows = ", ".join(f"({i}, '{kind}', {value}::double)" for i, kind, value in [(1, "view", 0), (2, "click", 4), (3, "view", 3), (4, "click", 9), (5, "error", 0), (7, "signup", 5), (8, "click", 2), (9, "error", 0)])
    duck = duckdb.connect()
    duck.execute(f"create table events as select event_id, timestamp '2024-01-01' as ts, event_id as user_id, event_type, value, '{{}}' as props from (values {rows}) t(event_id, event_type, value)")
    duck.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    df = catalog.queries()[name](spark, str(tmp_path))
    want = duck.execute(catalog.oracles()[name]).fetchall()
    got = [tuple(r) for r in df.select("kind", "first_seen", "result").collect()]
    assert got == want and {r[2] for r in got} > {0.0, None}
    operator = name.removeprefix("group_by_")
    plain = aggregates.group_by(spark.read.parquet(f"{tmp_path}/events.parquet"), ["event_type"], "value", operator, order_by="event_id")
    assert [r.result for r in plain.collect() if r.event_type in ("view", "error")] == [None, None]
