"""The criteria grammar: a criterion is parsed once, at plan time, and compiled to one predicate by the type of its column.

Prefixes ``>= <= <> > < =`` (equality without one). An empty operand asks for blanks
(``<>`` alone for non-blanks). Operands are numbers, dates, booleans (only real ones, not
text) or text with the wildcards ``*`` and ``?`` and the escape ``~``. Numbers match
numbers only and text matches text only; ``<>x`` holds for cells of another kind and for
blanks. Comparisons with raw columns are kept bare, so they reach the scan as filters.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import EPOCH_DAYS, MOMENT, NUMBER, NUMERIC, blank, col, dtype, serial

#: Longest first, so that ``>=`` is not read as ``>``.
PREFIXES = (">=", "<=", "<>", ">", "<", "=")
#: Date and time forms that criteria may be written in.
MOMENTS = ("%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%m/%d/%Y", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M")
TIMES = ("%H:%M:%S", "%H:%M")


@dataclass(frozen=True)
class Criterion:
    op: str
    kind: str  # blank, number, moment, bool or text
    value: object = None


def _moment(text: str) -> dt.datetime | float | None:
    for form in MOMENTS:
        try:
            return dt.datetime.strptime(text, form)
        except ValueError:
            pass
    for form in TIMES:
        try:
            t = dt.datetime.strptime(text, form)
            return (t.hour * 3600 + t.minute * 60 + t.second) / 86_400
        except ValueError:
            pass
    return None


def parse(criterion) -> Criterion:
    if isinstance(criterion, Criterion):
        return criterion
    if criterion is None:
        return Criterion("=", "blank")
    if isinstance(criterion, bool):
        return Criterion("=", "bool", criterion)
    if isinstance(criterion, (int, float)):
        return Criterion("=", "number", float(criterion))
    if isinstance(criterion, (dt.datetime, dt.date)):
        return Criterion("=", "moment", criterion if isinstance(criterion, dt.datetime) else dt.datetime(criterion.year, criterion.month, criterion.day))
    if not isinstance(criterion, str):
        raise ValueError(f"a criterion is a text, number, boolean, date or None, not {criterion!r}")
    op = next((p for p in PREFIXES if criterion.startswith(p)), "")
    rest = criterion[len(op) :]
    if rest == "":
        return Criterion("<>" if op == "<>" else "=", "blank")
    op = op or "="
    if len(rest) <= 64 and re.match(NUMBER, rest) and abs(float(rest)) != float("inf"):
        return Criterion(op, "number", float(rest))
    if any(c.isdigit() for c in rest):
        found = _moment(rest.strip())
        if isinstance(found, float):
            return Criterion(op, "number", found)
        if found is not None:
            return Criterion(op, "moment", found)
    return Criterion(op, "text", rest)


def wildcard(pattern: str) -> tuple[str, bool]:
    """A regular expression for a pattern with wildcards, and whether there is one; without, the plain text."""
    out, plain, wild, i = [], [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern) and pattern[i + 1] in "*?~":
            i += 1
            c = pattern[i]
        elif c in "*?":
            out.append(".*" if c == "*" else ".")
            wild = True
            i += 1
            continue
        plain.append(c)
        out.append(re.sub(r"([\\.\[\]{}()*+?^$|#&\-~])", r"\\\1", c))
        i += 1
    return ("".join(out), True) if wild else ("".join(plain), False)


def _compare(c: Column, op: str, value) -> Column:
    return {"=": c == value, "<>": c != value, ">": c > value, "<": c < value, ">=": c >= value, "<=": c <= value}[op]


def _serial_number(moment: dt.datetime) -> float:
    since = moment - dt.datetime(1970, 1, 1)
    return since.days + EPOCH_DAYS + since.seconds / 86_400


def compile_criterion(criterion, c: Column, kind: T.DataType, bare: bool = False) -> Column:
    """A predicate that is true or false, never null; ``bare`` ones may be null for false, which is as good in a filter and can be pushed to the scan."""
    k = parse(criterion)
    unlike = F.lit(k.op == "<>")
    if k.kind == "blank":
        return ~blank(c, kind) if k.op == "<>" else blank(c, kind)
    if k.kind == "bool":
        match = _compare(c, k.op, F.lit(k.value)) if isinstance(kind, T.BooleanType) else unlike
    elif k.kind in ("number", "moment"):
        if isinstance(kind, MOMENT):
            # Bare comparisons can be pushed down; a time of day against dates is compared as a number.
            if k.kind == "moment" and not (isinstance(kind, T.DateType) and k.value.time() != dt.time()):
                match = _compare(c, k.op, F.lit(k.value.date()) if isinstance(kind, T.DateType) else F.lit(str(k.value)).cast(kind))
            else:
                match = _compare(serial(c, kind), k.op, F.lit(k.value if k.kind == "number" else _serial_number(k.value)))
        elif isinstance(kind, NUMERIC):
            match = _compare(c, k.op, F.lit(k.value if k.kind == "number" else _serial_number(k.value)))
        else:
            match = unlike
    elif not isinstance(kind, T.StringType):
        match = unlike
    elif k.op in ("=", "<>"):
        text, wild = wildcard(k.value)
        match = c.rlike(f"(?isu)\\A{text}\\z") if wild else F.upper(c) == F.upper(F.lit(text))
        match = ~match if k.op == "<>" else match
        if k.op == "=":
            match = match & (c != "")
        else:
            match = match | (c == "")
    else:
        match = _compare(F.upper(c), k.op, F.upper(F.lit(k.value))) & (c != "")
    return match if bare and k.op != "<>" else F.coalesce(match, unlike)


def predicate(df: DataFrame, criteria, bare: bool = False) -> Column:
    """All of the (column, criterion) pairs; true for no pair."""
    parts = []
    for pair in criteria:
        if not isinstance(pair, (tuple, list)) or len(pair) != 2:
            raise ValueError(f"criteria are pairs of a column and a criterion, not {pair!r}")
        name, criterion = pair
        parts.append(compile_criterion(criterion, col(name), dtype(df, name), bare))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def matching(df: DataFrame, criteria) -> DataFrame:
    """The rows that meet all criteria, by a filter that reaches the scan."""
    return df.where(predicate(df, criteria, bare=True)) if criteria else df
