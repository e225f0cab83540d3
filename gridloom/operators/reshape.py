"""Cleaning, deduplication, reshaping, sorting and hashing of tables.

A block's row order is the caller's ``order_by``; its column order is the DataFrame's.
Operators on "all cells" take the columns as they are and leave the order column out.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import blank, col, dtype, filled, to_double, to_text
from ..plans import ranges


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _cells(df: DataFrame, order_by: str) -> list[str]:
    return [c for c in df.columns if c != order_by]


def trim_block(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Trims text and makes runs of Unicode white space one space."""
    return df.withColumns({c: F.trim(F.regexp_replace(col(c), r"(?U)\s+", " ")) for c in columns or _strings(df)})


def coerce_numeric(df: DataFrame, columns: Sequence[str] | None = None, *, keep: bool = True) -> DataFrame:
    """For each text column a column ``<name>_num``: its cells that read as numbers. Without ``keep``, text columns of which every non-blank cell is a number are replaced."""
    names = list(columns or _strings(df))
    numbers = {c: to_double(col(c), T.StringType()) for c in names}
    if keep:
        return df.withColumns({f"{c}_num": n for c, n in numbers.items()})
    if not names:
        return df
    odd = df.agg(*[F.count_if(n.isNull() & ~blank(col(c), T.StringType())).alias(c) for c, n in numbers.items()]).first()
    return df.withColumns({c: n for c, n in numbers.items() if odd[c] == 0})


def clean_range(df: DataFrame) -> DataFrame:
    """Trimmed, and numeric where it reads as numbers."""
    return coerce_numeric(trim_block(df), keep=False)


def remove_duplicate_rows(df: DataFrame, columns: Sequence[str], *, order_by: str) -> DataFrame:
    """The first of the rows that agree in ``columns``: with regard to case, blanks like empty text."""
    keys = [F.coalesce(to_text(col(c), dtype(df, c)), F.lit("")).alias(f"_k{i}") for i, c in enumerate(columns)]
    row = F.struct(*[col(c) for c in df.columns])
    return df.select(*keys, row.alias("_row"), col(order_by).alias("_o")).groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min_by("_row", "_o").alias("_row")).select("_row.*")


def transpose(df: DataFrame, index: str, most: int = 10_000) -> DataFrame:
    """Rows become columns named by ``index``: one row for each other column (``key``). The new width is the row count, of which ``most`` are allowed."""
    names = [r[0] for r in df.select(to_text(col(index), dtype(df, index))).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"a table of more than {most} rows can't be turned into columns")
    cells = [c for c in df.columns if c != index]
    long = df.select(to_text(col(index), dtype(df, index)).alias("_i"), F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("key"), to_text(col(c), dtype(df, c)).alias("v")) for i, c in enumerate(cells)])).alias("s"))
    return long.groupBy(F.col("s.at").alias("_at"), F.col("s.key").alias("key")).pivot("_i", sorted(n for n in names if n is not None)).agg(F.first("s.v")).orderBy("_at").drop("_at")


def fill_blanks(df: DataFrame, value, columns: Sequence[str] | None = None) -> DataFrame:
    """Blank and empty cells become ``value``."""
    return df.withColumns({c: F.coalesce(filled(col(c), dtype(df, c)), F.lit(value)) for c in columns or df.columns})


def split_column(df: DataFrame, column: str, delimiter: str, width: int | None = None, prefix: str | None = None) -> DataFrame:
    """Cells split at a literal delimiter into ``width`` columns (the widest row's, which takes one pass, if not given), padded with empty text."""
    if not delimiter:
        raise ValueError("the delimiter is empty")
    parts = F.split(F.coalesce(to_text(col(column), dtype(df, column)), F.lit("")), literal(delimiter), -1)
    if width is None:
        width = df.agg(F.max(F.size(parts))).first()[0] or 0
    return df.withColumns({f"{prefix or column}_{i + 1}": F.coalesce(F.get(parts, i), F.lit("")) for i in range(width)})


def literal(text: str) -> str:
    """A regular expression for the text itself."""
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", text)


def join_columns(df: DataFrame, delimiter: str, columns: Sequence[str] | None = None, out: str = "joined") -> DataFrame:
    """Adds ``out``: the text of the cells with the delimiter between, blanks as empty text."""
    return df.withColumn(out, F.concat_ws(delimiter, *[F.coalesce(to_text(col(c), dtype(df, c)), F.lit("")) for c in columns or df.columns]))


def java_replacement(text: str) -> str:
    """A replacement in the style ``$1 ${name} $& $$`` as Java reads it."""
    out, i = [], 0
    while i < len(text):
        two = text[i : i + 2]
        if two == "$$":
            out.append("\\$")
            i += 2
        elif two == "$&":
            out.append("$0")
            i += 2
        elif text[i] == "$" and re.match(r"\$(\d+|\{\w+\})", text[i:]):
            m = re.match(r"\$(\{(\d+)\}|\d+|\{\w+\})", text[i:])
            out.append(f"${m[2]}" if m[2] else m[0])
            i += len(m[0])
        else:
            out.append("\\" + text[i] if text[i] in "$\\" else text[i])
            i += 1
    return "".join(out)


def find_replace(df: DataFrame, find: str, replacement: str, *, regex: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """Replaces in text cells: the literal text, or what a regular expression finds."""
    if not find:
        raise ValueError("there is nothing to find")
    if regex:
        re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", find))
        change = lambda c: F.regexp_replace(c, F.lit(find), F.lit(java_replacement(replacement)))
    else:
        change = lambda c: F.replace(c, F.lit(find), F.lit(replacement))
    return df.withColumns({c: change(col(c)) for c in columns or _strings(df)})


def long_cells(df: DataFrame, order_by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """All cells as rows: column_index, column, the row's order and value (text if the types differ)."""
    names = list(columns or _cells(df, order_by))
    kinds = {dtype(df, c).simpleString() for c in names}
    value = (lambda c: col(c)) if len(kinds) == 1 else (lambda c: to_text(col(c), dtype(df, c)))
    cells = F.array(*[F.struct(F.lit(i).alias("column_index"), F.lit(c).alias("column"), value(c).alias("value")) for i, c in enumerate(names)])
    return df.select(col(order_by).alias("row"), F.explode(cells).alias("c")).select("row", "c.*")


def stack_columns(df: DataFrame, *, order_by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One column ``value`` of all cells, column after column; its order is (column_index, row)."""
    return long_cells(df, order_by, columns).orderBy("column_index", "row")


def unpivot(df: DataFrame, keys: Sequence[str], values: Sequence[str] | None = None) -> DataFrame:
    """Wide to long: the key columns, ``Attribute`` and ``Value`` (text if the types differ)."""
    names = [c for c in (values or df.columns) if c not in keys]
    same = len({dtype(df, c).simpleString() for c in names}) == 1
    wide = df if same else df.select(*[col(k) for k in keys], *[to_text(col(c), dtype(df, c)).alias(c) for c in names])
    return wide.unpivot([col(k) for k in keys], [col(c) for c in names], "Attribute", "Value")


def unique_count(df: DataFrame, *, order_by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Different non-blank cells of all columns with how often they occur, in the order first seen (row by row), with regard to case."""
    cells = long_cells(df, order_by, columns)
    value = filled(F.col("value"), cells.schema["value"].dataType)
    return cells.where(value.isNotNull()).groupBy("value").agg(F.count("*").alias("count"), F.min(F.struct("row", "column_index")).alias("_first")).orderBy("_first").drop("_first")


def unique(df: DataFrame, *, order_by: str, columns: Sequence[str] | None = None) -> DataFrame:
    return unique_count(df, order_by=order_by, columns=columns).select("value")


def sort_block(df: DataFrame, keys: Sequence[str], descending: Sequence[bool] | bool = False, *, order_by: str) -> DataFrame:
    """A stable sort by several keys: text that reads as numbers after them by value first, blanks as empty text; ties stay in the caller's order, also if descending."""
    falling = [descending] * len(keys) if isinstance(descending, bool) else list(descending)
    if len(falling) != len(keys):
        raise ValueError("descending has not one entry for each key")
    by: list[Column] = []
    for k, down in zip(keys, falling, strict=True):
        kind = dtype(df, k)
        if isinstance(kind, T.StringType):
            number = to_double(col(k), kind)
            text = F.when(number.isNull(), F.coalesce(col(k), F.lit("")))
            parts = [number.isNull(), number, text]
        else:
            parts = [col(k)]
        by += [p.desc_nulls_last() if down else p.asc_nulls_first() for p in parts]
    return df.orderBy(*by, col(order_by).asc())


def _row_bytes(df: DataFrame, columns: Sequence[str]) -> Column:
    """The text of the cells with a unit separator after each and a record separator after the row."""
    return F.concat(*[x for c in columns for x in (F.coalesce(to_text(col(c), dtype(df, c)), F.lit("")), F.lit("\x1f"))], F.lit("\x1e"))


def sha256_block(df: DataFrame, *, order_by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """SHA-256 (upper-case hexadecimal) of all cells in order.

    A digest of one stream needs the stream in one place: ranges of rows are put together first, then the ranges.
    """
    names = list(columns or _cells(df, order_by))
    rows = ranges.deal(df.select(_row_bytes(df, names).alias("t"), col(order_by).alias("o")), "o")
    parts = rows.groupBy(ranges.RANGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]), "").alias("t"))
    return parts.agg(F.upper(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ranges.RANGE, "t"))), lambda x: x["t"]), ""), 256)).alias("result"))


def hash_block(df: DataFrame, *, order_by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A 64-bit fingerprint of all cells and their order (upper-case hexadecimal).

    Made for any size: a hash of every row with its rank, added up. Its value is this library's own.
    """
    names = list(columns or _cells(df, order_by))
    dealt = ranges.deal(df, order_by)
    base = ranges.carried(dealt, [F.count("*").alias("_base")], F.sum)
    ranked = dealt.withColumn("_n", F.row_number().over(ranges.within([order_by]))).join(base, ranges.RANGE)
    row = F.xxhash64(_row_bytes(df, names), F.col("_n") + F.coalesce("_base", F.lit(0)))
    return ranked.agg(F.upper(F.lpad(F.lower(F.hex(F.bit_xor(row))), 16, "0")).alias("result"))


def fill_down(df: DataFrame, columns: Sequence[str] | None = None, *, order_by: str, partition_by: Sequence[str] | None = None) -> DataFrame:
    """Blank cells take the last non-blank cell above."""
    from .series import fill_forward

    return fill_forward(df, columns or _cells(df, order_by), order_by=order_by, partition_by=partition_by)


def concat_blocks(*blocks: DataFrame) -> DataFrame:
    """Blocks below each other, by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), blocks)


def write_block(df: DataFrame, target: str, mode: str = "overwrite") -> DataFrame:
    """Writes to a table, or to a Parquet path (with a slash in it), and gives what is there then."""
    if "/" in target:
        df.write.mode(mode).parquet(target)
        return df.sparkSession.read.parquet(target)
    df.write.mode(mode).saveAsTable(target)
    return df.sparkSession.table(target)


def round_trip(df: DataFrame, change, target: str | None = None) -> DataFrame:
    """A block changed and, if a target is named, written there and read again."""
    return df.transform(change) if target is None else write_block(df.transform(change), target)


