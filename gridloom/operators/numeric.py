"""Elementwise, row, column and matrix arithmetic.

``coalesce(x, 0)`` where the operator takes cells that are not numbers for 0; those of the
second family (``skip_*``) leave them out. Everything is a Column expression or one
aggregation, except matrix products of array rows, which may use BLAS.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import col, dtype, numeric, to_double


def _zero(df: DataFrame, name: str) -> Column:
    return F.coalesce(to_double(col(name), dtype(df, name)), F.lit(0.0))


def _plus(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def add(df: DataFrame, a: str, b: str, out: str = "result") -> DataFrame:
    return df.withColumn(out, _zero(df, a) + _zero(df, b))


def multiply(df: DataFrame, a: str, b: str, out: str = "result") -> DataFrame:
    return df.withColumn(out, _zero(df, a) * _zero(df, b))


def scale(df: DataFrame, columns: Sequence[str], factor: float) -> DataFrame:
    return df.withColumns({c: _zero(df, c) * F.lit(float(factor)) for c in columns})


def dot(df: DataFrame, a: str, b: str) -> DataFrame:
    """The sum of products, with 0 for cells that are not numbers."""
    return df.agg(F.coalesce(F.sum(_zero(df, a) * _zero(df, b)), F.lit(0.0)).alias("result"))


def skip_dot(df: DataFrame, a: str, b: str) -> DataFrame:
    """The sum of products of pairs of numbers."""
    x, y = (numeric(col(c), dtype(df, c)) for c in (a, b))
    return df.agg(F.coalesce(F.sum(x * y), F.lit(0.0)).alias("result"))


def row_sums(df: DataFrame, columns: Sequence[str], out: str = "row_sum") -> DataFrame:
    return df.withColumn(out, _plus([_zero(df, c) for c in columns]))


def skip_row_sums(df: DataFrame, columns: Sequence[str], out: str = "row_sum") -> DataFrame:
    return df.withColumn(out, _plus([F.coalesce(numeric(col(c), dtype(df, c)), F.lit(0.0)) for c in columns]))


def column_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.coalesce(F.sum(_zero(df, c)), F.lit(0.0)).alias(c) for c in columns])


def normalize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All cells over the length of the whole block as one vector; zeros if that is 0 or not finite."""
    cells = {c: _zero(df, c) for c in columns}
    length = df.agg(F.sqrt(F.sum(_plus([x * x for x in cells.values()]))).alias("_l"))  # one row
    fine = (F.col("_l") > 0) & (F.col("_l") != F.lit(float("inf"))) & ~F.isnan("_l")
    return df.crossJoin(F.broadcast(length)).withColumns({c: F.when(fine, x / F.col("_l")).otherwise(0.0) for c, x in cells.items()}).drop("_l")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two matrices in long form (i, j, v); missing entries count as 0.

    The inner index is the join key; the sums of products are combined before the shuffle.
    """
    left = a.select(F.col("i").alias("i"), F.col("j").alias("k"), F.col("v").alias("_a"))
    right = b.select(F.col("i").alias("k"), F.col("j").alias("j"), F.col("v").alias("_b"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


#: Entries of the right matrix that dense products send to every worker, at most (8 bytes each).
DENSE_ENTRIES = 4_000_000


def matmul_dense(a: DataFrame, vector: str, b: np.ndarray, out: str = "product") -> DataFrame:
    """Adds the product of each row's vector with a matrix of at most DENSE_ENTRIES entries."""
    b = np.asarray(b, float)
    if b.ndim != 2 or b.size > DENSE_ENTRIES:
        raise ValueError(f"the right matrix has two dimensions and at most {DENSE_ENTRIES} entries; use matmul")
    sent = a.sparkSession.sparkContext.broadcast(b)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def product(rows):
        import pandas as pd

        if not len(rows):
            return pd.Series([], dtype=object)
        block = np.stack([np.asarray(x, float) for x in rows])
        if block.shape[1] != sent.value.shape[0]:
            raise ValueError("the inner dimensions differ")
        return pd.Series(list(block @ sent.value))

    return a.withColumn(out, product(F.col(vector).cast("array<double>")))


def capabilities(spark) -> DataFrame:
    """One row: what the engine runs on."""
    on = lambda key: spark.conf.get(key, "false").lower() == "true"
    row = (spark.version, spark.sparkContext.defaultParallelism, on("spark.sql.codegen.wholeStage"), on("spark.sql.ansi.enabled"), on("spark.sql.adaptive.enabled"))
    return spark.createDataFrame([row], "version string, parallelism int, codegen boolean, ansi boolean, adaptive boolean")


def row_zscores(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """For each cell its z-score in the row (sample deviation); 0 without spread and for cells that are not numbers, which don't count."""
    x = {c: numeric(col(c), dtype(df, c)) for c in columns}
    n = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in x.values()], F.lit(0))
    held = df.withColumn("_n", n).withColumn("_m", F.try_divide(_plus([F.coalesce(v, F.lit(0.0)) for v in x.values()]), F.col("_n")))
    away = _plus([F.coalesce((v - F.col("_m")) * (v - F.col("_m")), F.lit(0.0)) for v in x.values()])
    held = held.withColumn("_s", F.when(F.col("_n") > 1, F.sqrt(away / (F.col("_n") - 1))))
    return held.withColumns({c + suffix: F.coalesce(F.when(F.col("_s") > 0, (v - F.col("_m")) / F.col("_s")), F.lit(0.0)) for c, v in x.items()}).drop("_n", "_m", "_s")


def poly_eval(df: DataFrame, x: str, coefficients: Sequence[float], out: str = "value") -> DataFrame:
    """A polynomial, lowest order first; 0 where x is not a number."""
    if not coefficients:
        raise ValueError("there are no coefficients")
    v = numeric(col(x), dtype(df, x))
    total = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        total = total * v + F.lit(float(c))
    return df.withColumn(out, F.when(v.isNull(), F.lit(0.0)).otherwise(total))


def tanh(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.tanh(_zero(df, c)) for c in columns})


def row_reduce(df: DataFrame, columns: Sequence[str], op: str, out: str = "reduced") -> DataFrame:
    """The sum, mean, min, max or sample stdev of a row, with 0 for cells that are not numbers."""
    cells = [_zero(df, c) for c in columns]
    n = len(cells)
    if not n:
        raise ValueError("there are no columns")
    mean = _plus(cells) / n
    made = {
        "sum": lambda: _plus(cells),
        "mean": lambda: mean,
        "min": lambda: F.least(*cells) if n > 1 else cells[0],
        "max": lambda: F.greatest(*cells) if n > 1 else cells[0],
        "stdev": lambda: F.sqrt(_plus([(c - mean) * (c - mean) for c in cells]) / (n - 1)) if n > 1 else F.lit(0.0),
    }
    if op not in made:
        raise ValueError(f"no operator {op!r}")
    return df.withColumn(out, made[op]())


def batch_transform(df: DataFrame, kernel, schema) -> DataFrame:
    """A user's function from pandas frames to pandas frames, over Arrow batches."""

    def run(frames):
        for frame in frames:
            yield kernel(frame)

    return df.mapInPandas(run, schema)
