"""Running, moving and ranking operators over an order.

Every operator takes ``order_by``, and an optional ``partition_by`` where there are many
series instead of one. Without partitions rows are dealt to ranges of
the order key; windows run within a range, and a table of one row a range carries what
comes before, so a long series is not one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import col, dtype, filled, numeric, to_double
from ..plans import ranges
from ..plans.ranges import RANGE
from .sliding import medians

LARGEST_WINDOW = 1_048_576


def _frame(order_by: str, partition_by: Sequence[str] | None, down: bool = True):
    by = ranges.ordered([order_by]) if down else [col(order_by).desc_nulls_last()]
    return Window.partitionBy(*[col(c) for c in partition_by or [RANGE]]).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)


def fill_forward(df: DataFrame, columns: Sequence[str], *, order_by: str | None = None, partition_by: Sequence[str] | None = None, direction: str = "down") -> DataFrame:
    """Blank cells take the nearest non-blank cell before them: above (down), below (up), left (right) or right (left)."""
    if direction in ("right", "left"):
        names = list(columns) if direction == "right" else list(columns)[::-1]
        cells = [filled(col(c), dtype(df, c)) for c in names]
        return df.withColumns({c: F.coalesce(*cells[i::-1]) for i, c in enumerate(names)})
    if direction not in ("down", "up"):
        raise ValueError(f"no direction {direction!r}: there are down, up, right and left")
    if order_by is None:
        raise ValueError("order_by is needed")
    frame = _frame(order_by, partition_by, direction == "down")
    cells = {c: filled(col(c), dtype(df, c)) for c in columns}
    if partition_by:
        return df.withColumns({c: F.last(v, ignorenulls=True).over(frame) for c, v in cells.items()})
    dealt = ranges.deal(df, order_by)
    pick = F.max_by if direction == "down" else F.min_by
    per = dealt.groupBy(RANGE).agg(*[pick(v, F.when(v.isNotNull(), F.struct(col(order_by)))).alias(f"_c{i}") for i, v in enumerate(cells.values())])
    turn = Window.orderBy(F.col(RANGE) if direction == "down" else F.col(RANGE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(RANGE, *[F.last(f"_c{i}", ignorenulls=True).over(turn).alias(f"_c{i}") for i in range(len(cells))])
    own = {c: F.last(v, ignorenulls=True).over(frame) for c, v in cells.items()}
    held = dealt.withColumns({f"_v{i}": v for i, v in enumerate(own.values())}).join(carry, RANGE)
    return held.select(*[F.coalesce(f"_v{list(columns).index(c)}", f"_c{list(columns).index(c)}").alias(c) if c in cells else col(c) for c in df.columns])


#: Running operators: what a range passes on, how ranges combine, and the running value of base and own part.
RUNNING = {
    "sum": (F.sum, F.sum, lambda a, b: a + b, 0.0),
    "count": (F.count, F.sum, lambda a, b: a + b, 0),
    "min": (F.min, F.min, F.least, None),
    "max": (F.max, F.max, F.greatest, None),
    "product": (F.product, F.product, lambda a, b: a * b, 1.0),
}


def running(df: DataFrame, value: str, op: str, *, order_by: str, partition_by: Sequence[str] | None = None, out: str = "running") -> DataFrame:
    """Adds the sum, count, average, min, max or product of all numbers so far; cells that are not numbers leave it as it was. Before the first number it is 0, the average null."""
    if op not in (*RUNNING, "average"):
        raise ValueError(f"no operator {op!r}")
    x = numeric(col(value), dtype(df, value))
    needed = ("sum", "count") if op == "average" else (op, "count")
    frame = _frame(order_by, partition_by)
    if partition_by:
        got = {k: RUNNING[k][0](x).over(frame) for k in needed}
        held = df.withColumns({f"_{k}": v for k, v in got.items()})
    else:
        dealt = ranges.deal(df, order_by)
        per = dealt.groupBy(RANGE).agg(*[RUNNING[k][0](x).alias(f"_b{k}") for k in dict.fromkeys(needed)])
        before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        carry = per.select(RANGE, *[RUNNING[k][1](f"_b{k}").over(before).alias(f"_b{k}") for k in dict.fromkeys(needed)])
        held = dealt.withColumns({f"_o{k}": RUNNING[k][0](x).over(frame) for k in dict.fromkeys(needed)}).join(carry, RANGE)

        def both(k: str) -> Column:
            a, b, neutral = F.col(f"_b{k}"), F.col(f"_o{k}"), RUNNING[k][3]
            return RUNNING[k][2](a, b) if neutral is None else RUNNING[k][2](F.coalesce(a, F.lit(neutral)), F.coalesce(b, F.lit(neutral)))

        held = held.withColumns({f"_{k}": both(k) for k in dict.fromkeys(needed)})
    if op == "average":
        result = F.try_divide(F.col("_sum"), F.col("_count"))
    elif op == "count":
        result = F.col("_count")
    else:
        result = F.when(F.col("_count") > 0, F.col(f"_{op}")).otherwise(F.lit(0.0))
    return held.select(*[col(c) for c in df.columns], result.alias(out))


MOVING = {
    "sum": F.sum,
    "average": F.avg,
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "stdev": F.stddev_samp,
}


def moving(df: DataFrame, value: str, window: int, op: str, *, order_by: str, min_periods: int | None = None, partition_by: Sequence[str] | None = None, out: str = "moving") -> DataFrame:
    """Adds an aggregate of the numbers in the last ``window`` rows; null where there are fewer than ``min_periods`` (all of the window, if not given).

    Without partitions a range is at least as long as the window, and gets the rows that its first windows reach back to from the range before.
    Medians slide along each series in a worker, which holds two windows' rows; other aggregates are Spark's own.
    """
    if op not in (*MOVING, "median"):
        raise ValueError(f"no operator {op!r}")
    if not 1 <= window <= LARGEST_WINDOW:
        raise ValueError(f"a window has 1 to {LARGEST_WINDOW} rows, not {window}")
    least = window if min_periods is None else min_periods
    if not 0 <= least <= window:
        raise ValueError("min_periods is not between 0 and the window")
    x = numeric(col(value), dtype(df, value))

    def added(rows: DataFrame, order) -> DataFrame:
        if op == "median":
            return medians(rows, x, order, window, least, out)
        frame = order.rowsBetween(-(window - 1), 0)
        return rows.withColumn(out, F.when(F.count(x).over(frame) >= least, MOVING[op](x).over(frame)))

    if partition_by:
        return added(df, ranges.within([order_by], partition_by))
    dealt = ranges.deal(df, order_by, least=2 * window)
    last = dealt.groupBy(RANGE).agg(F.count("*").alias("_size"))
    turn = Window.orderBy(RANGE)  # one row a range
    # A range may hold fewer rows than the window where keys repeat: rows reach as many ranges on as the window is long.
    sizes = last.withColumn("_upto", F.sum("_size").over(turn))
    ranked = dealt.withColumn("_back", F.row_number().over(Window.partitionBy(RANGE).orderBy(col(order_by).desc_nulls_last())))
    ahead = sizes.alias("a").join(sizes.alias("b"), (F.col(f"a.{RANGE}") < F.col(f"b.{RANGE}")) & (F.col("b._upto") - F.col("b._size") - F.col("a._upto") < window - 1)).select(F.col(f"a.{RANGE}").alias(RANGE), F.col(f"b.{RANGE}").alias("_to"), (F.col("b._upto") - F.col("b._size") - F.col("a._upto")).alias("_between"))
    copies = ranked.where(F.col("_back") < window).join(F.broadcast(ahead), RANGE).where(F.col("_back") + F.col("_between") < window).withColumn(RANGE, F.col("_to")).select(*[col(c) for c in df.columns], RANGE, F.lit(True).alias("_ghost"))
    both = dealt.withColumn("_ghost", F.lit(False)).unionByName(copies)
    return added(both, ranges.within([order_by])).where("not _ghost").select(*[col(c) for c in df.columns], out)


def outliers(df: DataFrame, value: str, method: str = "iqr", threshold: float = 0.0, *, out: str = "outlier") -> DataFrame:
    """Adds whether a number is an outlier of the whole column: beyond k quartile ranges (iqr, 1.5), k standard deviations (zscore, 3) or by the median deviation (mad, 3). Without spread zscore and mad flag nothing, iqr all that is off."""
    from .aggregates import exact_percentiles

    if method not in ("iqr", "zscore", "mad"):
        raise ValueError(f"no method {method!r}")
    k = threshold if threshold > 0 else {"iqr": 1.5, "zscore": 3.0, "mad": 3.0}[method]
    x = to_double(col(value), dtype(df, value))
    enough = df.agg(F.count(x).alias("_n"))
    if method == "iqr":
        stats = exact_percentiles(df, x, [0.25, 0.75])
        test = (x < F.col("p0") - k * (F.col("p1") - F.col("p0"))) | (x > F.col("p1") + k * (F.col("p1") - F.col("p0")))
    elif method == "zscore":
        stats = df.agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
        test = (F.col("_s") > 0) & (F.abs(x - F.col("_m")) > k * F.col("_s"))
    else:
        middle = exact_percentiles(df, x, [0.5])
        away = df.select(x.alias("_x")).crossJoin(F.broadcast(middle)).select(F.abs(F.col("_x") - F.col("p0")).alias("_a"))
        stats = middle.crossJoin(exact_percentiles(away, F.col("_a"), [0.5]).withColumnRenamed("p0", "_d"))
        test = (F.col("_d") > 0) & (0.6745 * F.abs(x - F.col("p0")) > k * F.col("_d"))
    held = df.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(enough))  # one row each
    return held.select(*[col(c) for c in df.columns], F.coalesce((F.col("_n") >= 2) & test, F.lit(False)).alias(out))


def quantiles(df: DataFrame, value: str, probabilities: Sequence[float]) -> DataFrame:
    """Inclusive quantiles, one row (``p``, ``quantile``) each; null for a probability outside 0..1."""
    from .aggregates import exact_percentiles

    got = exact_percentiles(df, to_double(col(value), dtype(df, value)), probabilities)
    return got.select(F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"p{i}").alias("quantile")) for i, p in enumerate(probabilities)])).alias("q")).select("q.*")


def _counted(df: DataFrame, x: Column, descending: bool) -> DataFrame:
    """Different numbers with their count, how many are before them and how many different ones."""
    counts = df.select(x.alias("_x")).where("_x is not null").groupBy("_x").agg(F.count("*").alias("_n"))
    key = counts.withColumn("_key", -F.col("_x") if descending else F.col("_x"))
    dealt = ranges.deal(key, "_key")
    base = ranges.carried(dealt, [F.sum("_n").alias("_b"), F.count("*").alias("_d")], F.sum)
    by = ranges.within(["_key"])
    own = dealt.withColumn("_s", F.sum("_n").over(by) - F.col("_n")).withColumn("_r", F.row_number().over(by))
    return own.join(base, RANGE).select("_x", "_n", (F.col("_s") + F.coalesce("_b", F.lit(0))).alias("_before"), (F.col("_r") + F.coalesce("_d", F.lit(0))).alias("_dense"))


def rank(df: DataFrame, value: str, *, ascending: bool = False, ties: str = "eq", order_by: str, out: str = "rank") -> DataFrame:
    """Adds the rank of numbers in the whole column: ties get the first rank (eq), their mean (avg), ranks without gaps (dense) or their own in order (ordinal). Null for other cells."""
    if ties not in ("eq", "avg", "dense", "ordinal"):
        raise ValueError(f"no tie rule {ties!r}")
    x = numeric(col(value), dtype(df, value))
    counted = _counted(df, x, not ascending)
    held = df.withColumn("_probe", x).join(counted.withColumnRenamed("_x", "_y"), F.col("_probe") == F.col("_y"), "left")
    if ties == "eq":
        r = (F.col("_before") + 1).cast("double")
    elif ties == "avg":
        r = F.col("_before") + 1 + (F.col("_n") - 1) / 2
    elif ties == "dense":
        r = F.col("_dense").cast("double")
    else:
        # Cells without a number have no place among ties, and don't meet in one partition.
        r = (F.col("_before") + F.row_number().over(Window.partitionBy("_probe").orderBy(col(order_by)))).cast("double")
        own = [col(c) for c in df.columns]
        return held.where("_probe is not null").select(*own, r.alias(out)).unionByName(held.where("_probe is null").select(*own, F.lit(None).cast("double").alias(out)))
    return held.select(*[col(c) for c in df.columns], r.alias(out))


def percent_rank(df: DataFrame, value: str, significance: int = 3, *, out: str = "percent_rank") -> DataFrame:
    """Adds the share of smaller numbers among the others, cut to ``significance`` digits; null with fewer than two numbers."""
    if significance < 1:
        raise ValueError("significance is at least 1")
    x = numeric(col(value), dtype(df, value))
    counted = _counted(df, x, False)
    total = df.agg(F.count(x).alias("_all"))
    held = df.withColumn("_probe", x).join(counted.withColumnRenamed("_x", "_y"), F.col("_probe") == F.col("_y"), "left").crossJoin(F.broadcast(total))
    scale = 10**significance
    # The share is a fraction of integers; it is cut before it becomes a double.
    cut = F.floor(F.col("_before") * scale / F.nullif(F.col("_all") - 1, F.lit(0))) / scale
    return held.select(*[col(c) for c in df.columns], F.when(F.col("_all") >= 2, cut).alias(out))
