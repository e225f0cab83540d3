"""Coercions between cell kinds, as Column expressions.

Typed mode: a column has one Spark type, and what a spreadsheet would show as an error is
null. Dates count days from 1899-12-30, the day that serial numbers start from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH_DAYS = 25_569
#: Text that reads as a number: digits with a point and an exponent, no thousands, no suffix.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
LONGEST_NUMBER = 64

NUMERIC = (T.NumericType,)
MOMENT = (T.DateType, T.TimestampType, T.TimestampNTZType)


def dtype(df: DataFrame, name: str) -> T.DataType:
    """The type of a column given by name (dots in names are taken literally)."""
    return df.schema[name].dataType


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def finite(c: Column) -> Column:
    """A double, with null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def serial(c: Column, kind: T.DataType) -> Column:
    """Days since 1899-12-30, with the time of day as the fraction."""
    days = (F.unix_date(c.cast("date")) + EPOCH_DAYS).cast("double")
    if isinstance(kind, T.DateType):
        return days
    moment = c.cast("timestamp_ntz")
    return days + (F.hour(moment) * 3600 + F.minute(moment) * 60 + F.extract(F.lit("SECOND"), moment).cast("double")) / 86_400


def to_double(c: Column, kind: T.DataType) -> Column:
    """Any cell that reads as a number: numbers, dates, TRUE as 1, and numeric text; else null."""
    if isinstance(kind, T.StringType):
        ok = (F.length(c) <= LONGEST_NUMBER) & c.rlike(NUMBER)
        return finite(F.when(ok, F.trim(c).try_cast("double")))
    return numeric(c, kind, booleans=True)


def numeric(c: Column, kind: T.DataType, booleans: bool = False) -> Column:
    """Cells that are numbers: text never, booleans only on request; else null."""
    if isinstance(kind, MOMENT):
        return serial(c, kind)
    if isinstance(kind, T.BooleanType) and booleans:
        return c.cast("double")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return finite(c.cast("double"))
    if isinstance(kind, NUMERIC):
        return c.cast("double")
    return F.lit(None).cast("double")


def to_text(c: Column, kind: T.DataType) -> Column:
    """Cell text: numbers without a needless fraction, TRUE and FALSE, ISO dates; null stays null."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.BooleanType):
        return F.upper(c.cast("string"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        x = c.cast("double")
        plain = F.regexp_replace(x.cast("string"), r"\.0E", "E")
        return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(plain)
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(kind, MOMENT):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return c.cast("string")


def blank(c: Column, kind: T.DataType) -> Column:
    """Null or, for text, empty."""
    return c.isNull() | (c == "") if isinstance(kind, T.StringType) else c.isNull()


def filled(c: Column, kind: T.DataType) -> Column:
    """Null where the cell is blank."""
    return F.nullif(c, F.lit("")) if isinstance(kind, T.StringType) else c


def group_key(c: Column, kind: T.DataType) -> Column:
    """What makes cells equal in grouping and counting: text without regard to case, blank and empty alike."""
    return F.upper(F.coalesce(c, F.lit(""))) if isinstance(kind, T.StringType) else c
