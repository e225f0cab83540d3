"""Medians of sliding windows.

A window frame of Spark's is gone through anew for every row. Here rows are brought to
their series' order by a window (which numbers them), and a worker slides along them: a
row costs the logarithm of the window, and a worker holds two windows' rows at most, or a batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.api.indexers import BaseIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACE, NUMBER = "_place", "_number"


class Frames(BaseIndexer):
    """Frames with given bounds, neither of which ever goes back."""

    def __init__(self, begin: np.ndarray, end: np.ndarray):
        super().__init__()
        self.begin, self.end = begin, end

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.begin, self.end


def slide(before: np.ndarray, x: np.ndarray, place: np.ndarray, window: int, least: int) -> np.ndarray:
    """Median of each row's frame: its last ``window`` rows, its series' first row (place 1) at most. NaN where under ``least`` rows, or none, have a number.

    ``before`` holds the numbers of the rows that come before the first one.
    """
    values = np.concatenate([before, x])
    end = np.arange(1, len(values) + 1)
    begin = np.zeros(len(values), np.int64)
    begin[len(before) :] = end[len(before) :] - np.minimum(place, window)
    counts = np.concatenate([[0], np.cumsum(~np.isnan(values))])
    middle = pd.Series(values).rolling(Frames(begin, end), min_periods=1).median().to_numpy()
    return np.where(counts[end] - counts[begin] >= max(1, least), middle, np.nan)[len(before) :]


def medians(df: DataFrame, value: Column, order, window: int, least: int, out: str) -> DataFrame:
    """Adds ``out``: the median of ``value`` in the last ``window`` rows of the series that ``order`` (a window specification) makes."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        before, held, rows = np.zeros(0), [], 0

        def answered():
            nonlocal before, held, rows
            column = lambda name: pa.chunked_array([b.column(name) for b in held])
            x = column(NUMBER).cast(pa.float64()).to_numpy().astype(float)
            got = slide(before, x, column(PLACE).to_numpy(), window, least)
            before = np.concatenate([before, x])[len(before) + len(x) - min(window - 1, len(before) + len(x)) :]
            at = 0
            for b in held:
                part = got[at : at + b.num_rows]
                at += b.num_rows
                own = b.select([n for n in b.schema.names if n not in (PLACE, NUMBER)])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(part, mask=np.isnan(part))], names=[*own.schema.names, out])
            held, rows = [], 0

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= window:
                yield from answered()
        if held:
            yield from answered()

    return df.withColumn(NUMBER, value).withColumn(PLACE, F.row_number().over(order)).mapInArrow(run, schema)
