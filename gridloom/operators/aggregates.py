"""Conditional aggregates, weighted statistics, grouping and conditional projection.

Every function takes a DataFrame and column names and returns a DataFrame; the global ones
give one row with the column ``result``. Criteria are (column, criterion) pairs. Numeric
operators ignore cells that are not numbers. Without a match sum, min, max, product and
count give 0, the others null. Order-sensitive ones need ``order_by``.

All of them are one partial and one final aggregation. Exact medians and percentiles count
equal values first and then walk the counts in order, so no task holds all values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import col, dtype, filled, group_key, numeric, to_text
from ..plans import ranges
from ..plans.criteria import compile_criterion, matching, predicate

Criteria = Sequence[tuple[str, object]]


def _value(df: DataFrame, name: str, criteria: Criteria = ()) -> Column:
    """The number in a matching cell, else null."""
    return F.when(predicate(df, criteria), numeric(col(name), dtype(df, name)))


def _number(df: DataFrame, name: str) -> Column:
    return numeric(col(name), dtype(df, name))


def _geomean(x: Column) -> Column:
    return F.when(F.min(x) > 0, F.exp(F.avg(F.when(x > 0, F.ln(x)))))


def _harmean(x: Column) -> Column:
    return F.when(F.min(x) > 0, F.count(x) / F.sum(F.try_divide(F.lit(1.0), x)))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


#: Operators that are one aggregate of the numbers.
SIMPLE = {
    "sum": lambda x: _zero(F.sum(x)),
    "average": F.avg,
    "min": lambda x: _zero(F.min(x)),
    "max": lambda x: _zero(F.max(x)),
    "stdev": F.stddev_samp,
    "stdevp": F.stddev_pop,
    "var": F.var_samp,
    "varp": F.var_pop,
    "product": lambda x: _zero(F.product(x)),
    "geomean": _geomean,
    "harmean": _harmean,
}
#: Means of positive numbers that tend to 0 with the smallest of them.
LIMITS = ("geomean", "harmean")
ALIASES = {"mean": "average", "distinctcount": "countdistinct", "counta": "count"}


def aggregate_ifs(df: DataFrame, requests: Sequence[tuple[str, str, str, Criteria]]) -> DataFrame:
    """Many conditional aggregates in one pass: (name, operator, column, criteria) each becomes a column of the one row."""
    out = []
    for name, op, value, criteria in requests:
        if op == "count":
            c = F.count_if(predicate(df, criteria))
        elif op in SIMPLE:
            c = SIMPLE[op](_value(df, value, criteria))
        else:
            raise ValueError(f"no operator {op!r} in one pass; there are count, {', '.join(SIMPLE)}")
        out.append(c.alias(name))
    return df.agg(*out)


def _one(op: str):
    def run(df: DataFrame, values: str, criteria: Criteria = ()) -> DataFrame:
        return matching(df, criteria).agg(SIMPLE[op](_number(df, values)).alias("result"))

    run.__name__ = f"{op}_ifs"
    run.__doc__ = f"The {op} of the numbers in matching rows."
    return run


sum_ifs, average_ifs, min_ifs, max_ifs = map(_one, ("sum", "average", "min", "max"))
stdev_ifs, stdevp_ifs, var_ifs, varp_ifs = map(_one, ("stdev", "stdevp", "var", "varp"))
product_ifs, geomean_ifs, harmean_ifs = map(_one, ("product", "geomean", "harmean"))


def count_ifs(df: DataFrame, criteria: Criteria) -> DataFrame:
    """How many rows match."""
    return matching(df, criteria).agg(F.count("*").alias("result"))


def exact_percentiles(df: DataFrame, value: Column, probabilities: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Inclusive percentiles (between neighbours by k(n - 1)) of a number, by ``keys``: columns p0, p1, ...

    Equal values are counted first; ranks are cumulative sums of the counts within a group and range of values, so that a
    group with many different values is several tasks. One row a group and range carries what comes before it. Groups that
    together have no more numbers than one range holds need no ranges.
    """
    rows = df.select(*keys, value.alias("_x")).where("_x is not null")
    counts = rows.groupBy(*keys, "_x").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    if keys and rows.count() <= ranges.ROWS:
        ranked = counts.withColumn("_upto", F.sum("_n").over(group.orderBy("_x"))).withColumn("_all", F.sum("_n").over(group))
        return _percentiles(ranked, probabilities, keys)
    dealt, at = ranges.deal(counts, "_x", ranges.ROWS if keys else None), [*keys, ranges.RANGE]
    per = dealt.groupBy(*at).agg(F.sum("_n").alias("_own"))
    before = F.sum("_own").over(group.orderBy(ranges.RANGE)) - F.col("_own")
    carry = per.select(*[F.col(c).alias(f"r{c}") for c in at], before.alias("_base"), F.sum("_own").over(group).alias("_all"))
    upto = F.sum("_n").over(Window.partitionBy(*at).orderBy("_x"))
    ranked = dealt.withColumn("_upto", upto).join(carry, [F.col(c).eqNullSafe(F.col(f"r{c}")) for c in at]).withColumn("_upto", F.col("_upto") + F.col("_base"))
    return _percentiles(ranked, probabilities, keys)


def _percentiles(ranked: DataFrame, probabilities: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Percentiles of values _x of which _upto of _all numbers are no greater."""
    out = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("_all") - 1)
        low = F.min(F.when(F.col("_upto") > F.floor(at), F.col("_x")))
        high = F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_x")))
        part = F.max(at - F.floor(at))
        out.append((F.when(low == high, low).otherwise(low + (high - low) * part) if 0 <= p <= 1 else F.lit(None).cast("double")).alias(f"p{i}"))
    return ranked.groupBy(*keys).agg(*out)


def percentile_ifs(df: DataFrame, values: str, k: float, criteria: Criteria = ()) -> DataFrame:
    """The inclusive k-th percentile of matching numbers; null outside 0..1 and without a match."""
    return exact_percentiles(matching(df, criteria), _number(df, values), [k]).select(F.col("p0").alias("result"))


def median_ifs(df: DataFrame, values: str, criteria: Criteria = ()) -> DataFrame:
    """The exact median of matching numbers."""
    return percentile_ifs(df, values, 0.5, criteria)


def mode_ifs(df: DataFrame, values: str, criteria: Criteria = (), *, order_by: str) -> DataFrame:
    """The most frequent matching number, the first seen among equals; null if none repeats."""
    counts = matching(df, criteria).select(_number(df, values).alias("x"), col(order_by).alias("o")).where("x is not null").groupBy("x").agg(F.count("*").alias("n"), F.min("o").alias("o"))
    return counts.where("n > 1").agg(F.min_by("x", F.struct(-F.col("n"), F.col("o"))).alias("result"))


def distinct_count_ifs(df: DataFrame, values: str, criteria: Criteria = (), *, approximate: bool = False) -> DataFrame:
    """How many different non-blank cells match, text without regard to case."""
    kind = dtype(df, values)
    key = group_key(filled(col(values), kind), kind)
    key = F.nullif(key, F.lit("")) if isinstance(kind, T.StringType) else key
    return matching(df, criteria).agg((F.approx_count_distinct(key) if approximate else F.count_distinct(key)).alias("result"))


def _edge(df: DataFrame, values: str, criteria: Criteria, order_by: str, pick) -> DataFrame:
    value = filled(col(values), dtype(df, values))
    return matching(df, criteria).where(value.isNotNull()).agg(pick(value, col(order_by)).alias("result"))


def first_ifs(df: DataFrame, values: str, criteria: Criteria = (), *, order_by: str) -> DataFrame:
    """The first matching non-blank cell."""
    return _edge(df, values, criteria, order_by, F.min_by)


def last_ifs(df: DataFrame, values: str, criteria: Criteria = (), *, order_by: str) -> DataFrame:
    """The last matching non-blank cell."""
    return _edge(df, values, criteria, order_by, F.max_by)


def text_join_ifs(df: DataFrame, text: str, delimiter: str, criteria: Criteria = (), *, order_by: str) -> DataFrame:
    """Matching texts in order with a delimiter between, blanks left out; an empty text without a match.

    Its result is one cell that holds all matching text; ranges of the order are joined first, then the ranges.
    """
    kind = dtype(df, text)
    rows = ranges.deal(matching(df, criteria).select(to_text(filled(col(text), kind), kind).alias("t"), col(order_by).alias("o")).where("t is not null"), "o")
    part = rows.groupBy(ranges.RANGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), delimiter).alias("t"))
    return part.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ranges.RANGE, "t"))), lambda x: x["t"]), delimiter).alias("result"))


def sum_product_ifs(df: DataFrame, a: str, b: str, criteria: Criteria = ()) -> DataFrame:
    """The sum of products in matching rows where both are numbers."""
    product = _number(df, a) * _number(df, b)
    return matching(df, criteria).agg(_zero(F.sum(product)).alias("result"))


def weighted_average(df: DataFrame, values: str, weights: str, criteria: Criteria = ()) -> DataFrame:
    """Sum of weight times value over sum of weights, where both are numbers; null if the weights sum to 0."""
    x, w = _number(df, values), _number(df, weights)
    return matching(df, criteria).agg(F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w))).alias("result"))


def weighted_average_ifs(df: DataFrame, values: str, weights: str, criteria: Criteria) -> DataFrame:
    return weighted_average(df, values, weights, criteria)


def _weighted(df: DataFrame, values: str, weights: str) -> DataFrame:
    rows = df.select(numeric(col(values), dtype(df, values)).alias("x"), numeric(col(weights), dtype(df, weights)).alias("w"))
    return rows.where("x is not null and w > 0")


def weighted_median(df: DataFrame, values: str, weights: str) -> DataFrame:
    """The smallest value up to which half of the (positive) weight lies."""
    sums = ranges.deal(_weighted(df, values, weights).groupBy("x").agg(F.sum("w").alias("w")), "x")
    base = ranges.carried(sums, [F.sum("w").alias("base")], F.sum)
    total = sums.agg(F.sum("w").alias("total"))
    ranked = sums.withColumn("upto", F.sum("w").over(ranges.within(["x"]))).join(base, ranges.RANGE).crossJoin(total)
    return ranked.where((F.col("upto") + F.coalesce("base", F.lit(0.0))) * 2 >= F.col("total")).agg(F.min("x").alias("result"))


def weighted_stdev(df: DataFrame, values: str, weights: str) -> DataFrame:
    """Weighted population standard deviation over positive weights, in two passes."""
    rows = _weighted(df, values, weights)
    mean = rows.agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))  # one row
    away = F.col("x") - F.col("m")
    return rows.crossJoin(F.broadcast(mean)).agg(F.sqrt(F.sum(F.col("w") * away * away) / F.sum("w")).alias("result"))


def group_by(df: DataFrame, keys: Sequence[str], value: str, op: str, *, order_by: str, zeros: bool = False) -> DataFrame:
    """Rows by key with ``result``: text keys without regard to case and shown as first seen, groups in the order first seen (column ``first_seen``).

    ``op`` is count (all cells), sum, average, min, max, median, stdev, stdevp, var, varp, product, mode, geomean, harmean, countdistinct, first or last.
    geomean and harmean of numbers that are not all positive are null; with ``zeros`` they are their limit, 0, where the smallest is 0.
    """
    op = ALIASES.get(op.lower(), op.lower())
    kind = dtype(df, value)
    x = numeric(col(value), kind)
    own = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[group_key(col(k), dtype(df, k)).alias(o) for k, o in zip(keys, own, strict=True)], *[col(k).alias(f"_s{i}") for i, k in enumerate(keys)], x.alias("_x"), filled(col(value), kind).alias("_v"), col(order_by).alias("_o"))
    shown = [F.min_by(f"_s{i}", "_o").alias(k) for i, k in enumerate(keys)]
    seen = F.min("_o").alias("first_seen")
    if op in SIMPLE:
        result = SIMPLE[op](F.col("_x"))
        if zeros and op in LIMITS:
            result = F.when(F.min("_x") == 0, F.lit(0.0)).otherwise(result)
        out = rows.groupBy(*own).agg(*shown, seen, result.alias("result"))
    elif op == "count":
        out = rows.groupBy(*own).agg(*shown, seen, F.count("*").alias("result"))
    elif op == "countdistinct":
        out = rows.groupBy(*own).agg(*shown, seen, F.count_distinct(group_key(F.col("_v"), kind) if not isinstance(kind, T.StringType) else F.upper("_v")).alias("result"))
    elif op in ("first", "last"):
        pick = F.min_by if op == "first" else F.max_by
        out = rows.groupBy(*own).agg(*shown, seen, pick("_v", F.when(F.col("_v").isNotNull(), F.col("_o"))).alias("result"))
    elif op == "median":
        middle = exact_percentiles(rows, F.col("_x"), [0.5], own)
        out = _beside(rows.groupBy(*own).agg(*shown, seen), middle.withColumnRenamed("p0", "result"), own)
    elif op == "mode":
        counts = rows.where("_x is not null").groupBy(*own, "_x").agg(F.count("*").alias("_n"), F.min("_o").alias("_f")).where("_n > 1")
        best = counts.groupBy(*own).agg(F.min_by("_x", F.struct(-F.col("_n"), F.col("_f"))).alias("result"))
        out = _beside(rows.groupBy(*own).agg(*shown, seen), best, own)
    else:
        raise ValueError(f"no operator {op!r}")
    return out.select(*keys, "first_seen", "result").orderBy("first_seen")


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys where null equals null."""
    renamed = right.select(*[F.col(k).alias(f"r{k}") for k in keys], "result")
    on = [F.col(k).eqNullSafe(F.col(f"r{k}")) for k in keys]
    return left.join(renamed, on, "left")


def case_when(df: DataFrame, test: str, cases: Sequence[tuple[object, object]], default=None, *, out: str = "result") -> DataFrame:
    """Adds ``out``: the result of the first criterion that the cell meets. Results are values, or Columns for cells of the same row."""
    if not cases:
        raise ValueError("there is no case")
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    chain = None
    for criterion, result in cases:
        met = compile_criterion(criterion, col(test), dtype(df, test))
        chain = F.when(met, as_column(result)) if chain is None else chain.when(met, as_column(result))
    return df.withColumn(out, chain.otherwise(as_column(default)))
