"""Lookups: left joins that find at most one row for each probe.

Exact lookups take the first key in order and tell text without regard to case from
numbers; a found blank is a blank and not a miss. Floor lookups take the largest key that
is not above the probe, and of equal keys the last. Row counts of the probe side never
change. The join strategy is Catalyst's: a small lookup side is broadcast by its
measured size, a large one is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import col, dtype, numeric, to_text
from ..plans import ranges

_HIT = "_hit"
#: Rows of a table up to which a floor lookup compares probes with the keys as literals, instead of laying both out.
FEW = 64


def _same_kind(a: T.DataType, b: T.DataType) -> bool:
    text = [isinstance(x, T.StringType) for x in (a, b)]
    return text[0] == text[1]


def _exact_key(c: Column, kind: T.DataType) -> Column:
    return F.upper(c) if isinstance(kind, T.StringType) else c if isinstance(kind, T.BooleanType) else numeric(c, kind)


def lookup_exact(probes: DataFrame, probe: str, table: DataFrame, key: str, returns: Sequence[str], *, order_by: str, if_not_found=None, case_sensitive_text: bool = False) -> DataFrame:
    """The probes with the ``returns`` columns of the first row whose key equals the probe; blanks match blanks.

    ``case_sensitive_text`` compares keys as text instead (5 equals "5"), with regard to case.
    """
    a, b = dtype(probes, probe), dtype(table, key)
    out = [r if r not in probes.columns else f"{r}_found" for r in returns]
    if not case_sensitive_text and not _same_kind(a, b):
        missing = [F.lit(if_not_found).cast(dtype(table, r)).alias(o) for r, o in zip(returns, out, strict=True)]
        return probes.select("*", *missing)
    make = (lambda c, k: F.coalesce(to_text(c, k), F.lit(""))) if case_sensitive_text else _exact_key
    build = table.select(make(col(key), b).alias("_key"), F.struct(*[col(r).alias(f"r{i}") for i, r in enumerate(returns)]).alias("_row"), col(order_by).alias("_o"))
    first = build.groupBy("_key").agg(F.min_by("_row", "_o").alias("_row"), F.lit(True).alias(_HIT))
    joined = probes.withColumn("_probe", make(col(probe), a)).join(first, F.col("_probe").eqNullSafe(F.col("_key")), "left")
    found = [F.when(F.col(_HIT), F.col(f"_row.r{i}")).otherwise(F.lit(if_not_found).cast(dtype(table, r))).alias(o) for i, (r, o) in enumerate(zip(returns, out, strict=True))]
    return joined.select(*[col(c) for c in probes.columns], *found)


def _floor_of(value: Column, ends: list, kind: T.DataType) -> Column:
    """The largest of the sorted ``ends`` that is not above ``value``, found by halves; null if there is none."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(ends[low - 1] if low else None).cast(kind)
        middle = (low + high) // 2
        return F.when(value < F.lit(ends[middle]), within(low, middle)).otherwise(within(middle + 1, high))

    return F.when(value.isNotNull(), within(0, len(ends)))


def _laid_out(keys: DataFrame, asked: DataFrame) -> DataFrame:
    """Each different probe as _y, with the key and row found for it."""
    both = keys.withColumn("_asked", F.lit(False)).unionByName(asked.where("_x is not null").select("_x", F.lit(None).cast(keys.schema["_row"].dataType).alias("_row"), F.lit(True).alias("_asked")).distinct())
    dealt = ranges.deal(both, "_x")
    hit = F.struct("_x", "_row")
    before = ranges.carried(dealt, [F.max_by(hit, F.when(~F.col("_asked"), F.col("_x"))).alias("_carry")], lambda c: F.last(c, ignorenulls=True))
    window = Window.partitionBy(ranges.RANGE).orderBy("_x", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    held = dealt.withColumn("_found", F.last(F.when(~F.col("_asked"), hit), ignorenulls=True).over(window)).where("_asked").join(before, ranges.RANGE)
    return held.select(F.col("_x").alias("_y"), F.coalesce("_found", "_carry").alias("_found"))


def lookup_floor(probes: DataFrame, probe: str, table: DataFrame, key: str, returns: Sequence[str], *, order_by: str, if_not_found=None) -> DataFrame:
    """The probes with the ``returns`` of the largest numeric key not above the probe (the last of equal keys); text and blank probes miss.

    Both sides are laid out by value in ranges, each different probe once; within a range the last key before a probe is a running
    maximum, and what comes from the ranges before is one row a range. The answers are joined back to the probes. No cross join, no
    single task, and equal probes don't meet in one range. A table of FEW rows or fewer isn't laid out: there each probe is
    compared with the keys as literals, and the key found is joined.
    """
    out = [r if r not in probes.columns else f"{r}_found" for r in returns]
    number = lambda df, name: numeric(col(name), dtype(df, name), booleans=True)
    row = F.struct(*[col(r).alias(f"r{i}") for i, r in enumerate(returns)])
    keys = table.select(number(table, key).alias("_x"), row.alias("_row"), col(order_by).alias("_o")).where("_x is not null").groupBy("_x").agg(F.max_by("_row", "_o").alias("_row"))
    asked = probes.withColumn("_x", number(probes, probe))
    kind = keys.schema["_x"].dataType
    ends = [r[0] for r in table.select(number(table, key).alias("_x")).where("_x is not null").limit(FEW + 1).collect()]
    if len(ends) <= FEW:
        asked = asked.withColumn("_y", _floor_of(F.col("_x"), sorted(ends), kind))
        answer = keys.select(F.col("_x").alias("_y"), F.struct("_x", "_row").alias("_found"))
    else:
        asked, answer = asked.withColumn("_y", F.col("_x")), _laid_out(keys, asked)
    every = asked.join(answer, "_y", "left")
    found = [F.when(F.col("_found").isNotNull(), F.col(f"_found._row.r{i}")).otherwise(F.lit(if_not_found).cast(dtype(table, r))).alias(o) for i, (r, o) in enumerate(zip(returns, out, strict=True))]
    return every.select(*[col(c) for c in probes.columns], *found)


def xlookup(probes, probe, table, key, returns, *, order_by, if_not_found=None, match_mode=0) -> DataFrame:
    """Exact by default; ``match_mode`` -1 (or False) for the floor."""
    if match_mode in (0, True) and match_mode is not False:
        return lookup_exact(probes, probe, table, key, returns, order_by=order_by, if_not_found=if_not_found)
    if match_mode is False or match_mode == -1:
        return lookup_floor(probes, probe, table, key, returns, order_by=order_by, if_not_found=if_not_found)
    raise ValueError(f"no match mode {match_mode!r}: there are 0 (exact) and -1 (floor)")


def vlookup(probes, probe, table, column_indexes: Sequence[int], *, order_by, if_not_found=None, range_lookup: bool = True) -> DataFrame:
    """Looks up in the table's first column; ``column_indexes`` count from 1. Approximate unless told otherwise."""
    names = table.columns
    for i in column_indexes:
        if not 1 <= i <= len(names):
            raise ValueError(f"column index {i} is outside 1..{len(names)}")
    return xlookup(probes, probe, table, names[0], [names[i - 1] for i in column_indexes], order_by=order_by, if_not_found=if_not_found, match_mode=-1 if range_lookup else 0)


def map_values(df: DataFrame, column: str, mapping: Sequence[tuple[object, object]], *, if_missing=None, pass_through: bool = True, out: str | None = None) -> DataFrame:
    """Recodes cells by (old, new) pairs, the first of equal olds; others pass unless ``pass_through`` is off, then they become ``if_missing``."""
    kind = dtype(df, column)
    known: dict = {}
    for old, new in mapping:
        known.setdefault(old.upper() if isinstance(old, str) else old, new)
    same = {k: v for k, v in known.items() if isinstance(k, str) == isinstance(kind, T.StringType)}
    c = col(column)
    if not same:
        return df.withColumn(out or column, c if pass_through else F.lit(if_missing))
    pairs = [F.lit(x) for k, v in same.items() for x in (k, v)]
    key = F.upper(c) if isinstance(kind, T.StringType) else c
    table = F.create_map(*pairs)
    hit = F.array_contains(F.array(*[F.lit(k) for k in same]), key)
    found = F.try_element_at(table, key)
    other = c if pass_through else F.lit(if_missing)
    return df.withColumn(out or column, F.when(hit, found).otherwise(other))


def block_lookup(left: DataFrame, left_index: int, table: DataFrame, return_indexes: Sequence[int], *, order_by: str, key_index: int = 0) -> DataFrame:
    """Joins by the text of cells, with regard to case; indexes count from 0."""
    for i, df in ((left_index, left), (key_index, table), *((i, table) for i in return_indexes)):
        if not 0 <= i < len(df.columns):
            raise ValueError(f"column index {i} is outside 0..{len(df.columns) - 1}")
    return lookup_exact(left, left.columns[left_index], table, table.columns[key_index], [table.columns[i] for i in return_indexes], order_by=order_by, case_sensitive_text=True)
