"""Regular expressions on Columns (Java's syntax; there is no time limit). Blank cells don't match."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coerce import col

_GROUP = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|(\((?!\?)|\(\?<(?![=!]))", re.S)


def groups(pattern: str) -> int:
    """How many capturing groups a pattern has."""
    return sum(1 for m in _GROUP.finditer(pattern) if m[1])


def _checked(pattern: str, ignore_case: bool) -> str:
    if not pattern:
        raise ValueError("the pattern is empty")
    return ("(?iu)" if ignore_case else "") + pattern


def regex_match(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.coalesce(text.rlike(_checked(pattern, ignore_case)), F.lit(False))


def regex_count(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_checked(pattern, ignore_case))), F.lit(0))


def regex_extract(text: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    """The first match or its group; empty if there is none, also of the group."""
    if group > groups(pattern) or group < 0:
        return F.when(text.isNotNull(), F.lit(""))
    return F.regexp_extract(text, _checked(pattern, ignore_case), group)


def regex_extract_all(text: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    """All matches (or what the group took in them) as an array."""
    if group > groups(pattern) or group < 0:
        return F.array().cast("array<string>")
    return F.coalesce(F.regexp_extract_all(text, F.lit(_checked(pattern, ignore_case)), group), F.array().cast("array<string>"))


def regex_split(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """The stretches between matches as an array, with what groups captured in a match between the two beside it (a group that took no part: empty text)."""
    parts, n = F.split(text, _checked(pattern, ignore_case), -1), groups(pattern)
    if not n:
        return parts
    taken = [regex_extract_all(text, pattern, i + 1, ignore_case) for i in range(n)]
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda part, i: F.array(*[F.coalesce(F.get(t, i), F.lit("")) for t in taken], part))
    return F.concat(F.slice(parts, 1, 1), F.flatten(rest))


def spread(df: DataFrame, array: Column, prefix: str, width: int | None = None) -> DataFrame:
    """Adds columns of an array's entries, padded with empty text; the widest row decides (in one pass) unless ``width`` is given."""
    if width is None:
        width = df.agg(F.max(F.size(array))).first()[0] or 0
    return df.withColumns({f"{prefix}_{i + 1}": F.coalesce(F.get(array, i), F.lit("")) for i in range(width)})


def column_regex(df: DataFrame, name: str, function, *args, **kwargs) -> Column:
    return function(col(name).cast("string"), *args, **kwargs)
