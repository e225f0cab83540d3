"""Whole-table order without a single task.

A window without partitions runs in one task. Instead, rows are dealt to ranges of nearly
equal counts of the (numeric or date) order key; windows run within the ranges, and what
crosses their borders is carried by a table of one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import MOMENT, col, dtype

RANGE = "_range"
#: Rows of a range, about, and ranges at most.
ROWS, MOST = 100_000, 16_384
#: Ends that are looked for along with the number of rows.
GRID = 1024


def sortable(df: DataFrame, name: str) -> Column | None:
    """The order key as a number, or None if its type has no such order."""
    kind = dtype(df, name)
    if isinstance(kind, T.NumericType):
        return col(name).cast("double") if not isinstance(kind, T.IntegralType) else col(name).cast("bigint")
    if isinstance(kind, MOMENT):
        return F.unix_micros(col(name).cast("timestamp"))
    return None


def deal(df: DataFrame, name: str, least: int | None = None) -> DataFrame:
    """Adds RANGE: rows with a smaller key are never in a later range, equal keys are in one; nulls come first.

    Keys that are neither numbers nor dates can't be dealt: all rows are then in range 0. ``least`` is the number of rows
    that a range should have at least.
    """
    key = sortable(df, name)
    if key is None:
        return df.withColumn(RANGE, F.lit(0))
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The number of rows and a grid of ends in one pass; a second one only where more ranges are asked for.
    count, grid = df.agg(F.count("*"), F.percentile_approx(key, [i / GRID for i in range(1, GRID)], 20 * GRID)).first()
    size = max(least or 0, min(ROWS, -(-count // max(1, shuffle))))
    n = max(1, min(MOST, -(-count // max(1, size))))
    if n <= GRID:
        found = [(grid or [])[i * GRID // n - 1] for i in range(1, n) if grid]
    else:
        found = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0]
    ends = sorted({x for x in found or []})
    if not ends:
        return df.withColumn(RANGE, F.lit(0))
    # Two short searches instead of a long one: the group of ends first, then the end in the group.
    step = max(1, int(len(ends) ** 0.5))
    groups = [ends[i : i + step] for i in range(0, len(ends), step)]
    below = lambda values: F.size(F.filter(values, lambda x: x < key))
    first = below(F.lit(ends[step - 1 :: step]) if len(ends) >= step else F.array())
    held = df.withColumn("_group", F.when(key.isNull(), 0).otherwise(first))
    inner = below(F.coalesce(F.get(F.array(*[F.lit(g) for g in groups]), F.col("_group")), F.array().cast(f"array<{'double' if isinstance(ends[0], float) else 'bigint'}>")))
    return held.withColumn(RANGE, F.when(key.isNull(), 0).otherwise(F.col("_group") * step + inner)).drop("_group")


def ordered(order: list[str]) -> list[Column]:
    return [col(c).asc_nulls_first() for c in order]


def within(order: list[str], partition: list[str] | None = None):
    """The window of a range (or of the caller's partitions) in order."""
    return Window.partitionBy(*[col(c) for c in (partition or [RANGE])]).orderBy(*ordered(order))


def carried(dealt: DataFrame, aggregates: list[Column], combine) -> DataFrame:
    """RANGE and, for every range, ``combine(name)`` over all ranges before it of the range's ``aggregates``."""
    per = dealt.groupBy(RANGE).agg(*aggregates)
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # MOST rows at most
    return per.select(RANGE, *[combine(F.col(c)).over(before).alias(c) for c in per.columns if c != RANGE])
