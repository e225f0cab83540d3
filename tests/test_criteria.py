"""The criteria grammar against a plain matcher, and the cases that are easily got wrong."""

import datetime as dt
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gridloom.operators import aggregates as A
from gridloom.plans.criteria import compile_criterion, parse, wildcard


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(1, 5.0, "5", True, dt.date(2020, 6, 15)), (2, -1.0, "apple", False, dt.date(2025, 1, 1)), (3, None, "", None, None), (4, 1.0, None, True, dt.date(2026, 3, 3)), (5, 7.5, "a*b", False, dt.date(1999, 12, 31)), (6, 0.0, "AXB", True, dt.date(2025, 1, 2))]
    return spark.createDataFrame(rows, "id int, num double, txt string, flag boolean, day date").cache()


@pytest.mark.parametrize(
    "column, criterion, want",
    [
        ("num", ">0", [1, 4, 5]),
        ("num", "<>5", [2, 3, 4, 5, 6]),
        ("num", "", [3]),
        ("num", "<>", [1, 2, 4, 5, 6]),
        ("num", ">", [3]),
        ("num", "*", []),
        ("num", True, []),
        ("num", "<>x", [1, 2, 3, 4, 5, 6]),
        ("txt", "5", []),
        ("txt", "<>5", [1, 2, 3, 4, 5, 6]),
        ("txt", "", [3, 4]),
        ("txt", "<>", [1, 2, 5, 6]),
        ("txt", "APPLE", [2]),
        ("txt", "<>apple", [1, 3, 4, 5, 6]),
        ("txt", "a?b", [5, 6]),
        ("txt", "a~*b", [5]),
        ("txt", "*p*", [2]),
        ("txt", "<>a*", [1, 3, 4]),
        ("txt", ">b", []),
        ("txt", "<b", [1, 2, 5, 6]),
        ("flag", True, [1, 4, 6]),
        ("flag", "TRUE", []),
        ("flag", 1, []),
        ("day", ">1/1/2025", [4, 6]),
        ("day", "2025-01-01", [2]),
        ("day", "<>2025-01-01", [1, 3, 4, 5, 6]),
        ("day", ">=45658", [2, 4, 6]),
        ("num", ">1/1/2025", []),
    ],
)
def test_cases(cells, column, criterion, want):
    kind = cells.schema[column].dataType
    got = cells.where(compile_criterion(criterion, cells[column], kind)).select("id").collect()
    assert sorted(r[0] for r in got) == want


def like(pattern: str, text: str) -> bool:
    """A matcher for wildcards, character by character."""
    if not pattern:
        return not text
    if pattern[0] == "~" and pattern[1:2] and pattern[1] in "*?~":
        return bool(text) and text[0].lower() == pattern[1].lower() and like(pattern[2:], text[1:])
    if pattern[0] == "*":
        return like(pattern[1:], text) or bool(text) and like(pattern, text[1:])
    return bool(text) and (pattern[0] == "?" or pattern[0].lower() == text[0].lower()) and like(pattern[1:], text[1:])


@settings(max_examples=300, suppress_health_check=list(HealthCheck), deadline=None)
@given(st.text("aB.*?~(", max_size=6), st.text("aAbB.*~(", max_size=6))
def test_wildcards(pattern, text):
    form, wild = wildcard(pattern)
    got = re.fullmatch(form, text, re.S | re.I) is not None if wild else form.lower() == text.lower()
    assert got == like(pattern, text)


@pytest.mark.parametrize("text", ["NaN", "Infinity", "1e999", "5d", "1,5", ""])
def test_not_numbers(spark, text):
    from gridloom.functions.coerce import to_double
    from pyspark.sql import types as T

    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(to_double(df.t, T.StringType())).first()[0] is None


def test_numbers(spark):
    from gridloom.functions.coerce import to_double, to_text
    from pyspark.sql import types as T

    df = spark.createDataFrame([(" 1.5 ", 5.0), ("-.5e2", 1e17), ("+3.", 0.1)], "t string, x double")
    rows = df.select(to_double(df.t, T.StringType()), to_text(df.x, T.DoubleType())).collect()
    assert [r[0] for r in rows] == [1.5, -50.0, 3.0]
    assert [r[1] for r in rows] == ["5", "1E17", "0.1"]


def test_errors(cells):
    with pytest.raises(ValueError):
        A.sum_ifs(cells, "num", [("num",)])
    with pytest.raises(ValueError):
        parse(object())
    with pytest.raises(ValueError):
        A.group_by(cells, ["txt"], "num", "nothing", order_by="id")


def test_empty_matches(cells):
    none = [("id", ">100")]
    for op in ("sum_ifs", "min_ifs", "max_ifs", "product_ifs"):
        assert getattr(A, op)(cells, "num", none).first()[0] == 0
    for op in ("average_ifs", "stdev_ifs", "var_ifs", "median_ifs", "geomean_ifs", "harmean_ifs"):
        assert getattr(A, op)(cells, "num", none).first()[0] is None
    assert A.geomean_ifs(cells, "num").first()[0] is None
    assert A.harmean_ifs(cells, "num").first()[0] is None
    assert A.mode_ifs(cells, "num", order_by="id").first()[0] is None
    assert A.first_ifs(cells, "txt", none, order_by="id").first()[0] is None
    assert A.stdev_ifs(cells, "num", [("id", 1)]).first()[0] is None
    assert A.percentile_ifs(cells, "num", 1.5).first()[0] is None
    assert A.text_join_ifs(cells, "txt", ",", none, order_by="id").first()[0] == ""


def test_order_and_ties(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (2, "A", 3.0), (3, "a", 3.0), (4, "B", 2.0), (5, None, 9.0), (6, "", 1.0)], "id int, k string, v double")
    assert A.mode_ifs(df, "v", order_by="id").first()[0] == 2.0
    got = [(r.k, r.result) for r in A.group_by(df, ["k"], "v", "sum", order_by="id").collect()]
    assert got == [("b", 4.0), ("A", 6.0), (None, 10.0)]
    assert A.distinct_count_ifs(df, "k").first()[0] == 2
    assert A.percentile_ifs(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "x double"), "x", 0.5).first()[0] == 3.0
    assert A.weighted_median(spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, -5.0)], "x double, w double"), "x", "w").first()[0] == 1.0
    assert A.weighted_average(spark.createDataFrame([(1.0, 1.0), (2.0, -1.0)], "x double, w double"), "x", "w").first()[0] is None
