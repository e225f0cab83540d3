"""Text functions on Columns. Null stays null; only text is expected (use ``to_text`` for other cells)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coerce import col, dtype, to_text

LONGEST_REPEAT = 32_767


def _literal(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", text)


def _pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)


def _capital(x: Column) -> Column:
    return F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 2_147_483_647)))


def proper(text: Column) -> Column:
    """A capital after everything that is not a letter, small letters else."""
    return F.array_join(F.transform(_pieces(text, r"\p{L}+|[^\p{L}]+"), _capital), "")


def title_case(text: Column) -> Column:
    """Words with a capital, of which an apostrophe is part; words in capitals stay."""
    word = r"\p{L}[\p{L}\p{M}'’]*"
    change = lambda x: F.when(~x.rlike(r"^\p{L}") | ((F.upper(x) == x) & (F.length(x) > 1)), x).otherwise(_capital(x))
    return F.array_join(F.transform(_pieces(text, rf"{word}|[^\p{{L}}]+"), change), "")


def camel_case(text: Column) -> Column:
    """Words joined, the first in small letters, the others with a capital."""
    words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{Nd}]+)"), 1)
    return F.array_join(F.transform(words, lambda x, i: F.when(i == 0, F.lower(x)).otherwise(_capital(x))), "")


def pad_left(text: Column, width: int, pad: str = " ") -> Column:
    """Padded to ``width``, never cut; blanks stay."""
    if not pad:
        raise ValueError("there is nothing to pad with")
    return F.when((F.length(text) < width) & (text != ""), F.lpad(text, width, pad)).otherwise(text)


def pad_right(text: Column, width: int, pad: str = " ") -> Column:
    if not pad:
        raise ValueError("there is nothing to pad with")
    return F.when((F.length(text) < width) & (text != ""), F.rpad(text, width, pad)).otherwise(text)


def zero_pad(text: Column, width: int) -> Column:
    return pad_left(text, width, "0")


def repeat(text: Column, n: int) -> Column:
    if not 0 <= n <= LONGEST_REPEAT:
        raise ValueError(f"a text is repeated 0 to {LONGEST_REPEAT} times, not {n}")
    return F.repeat(text, n)


def reverse(text: Column) -> Column:
    """By code points, so that no character outside the basic plane is torn."""
    return F.reverse(text)


def substitute(text: Column, old: str, new: str, nth: int | None = None) -> Column:
    """All occurrences of ``old``, or the nth of those that don't overlap."""
    if not old:
        return text
    if nth is None:
        return F.replace(text, F.lit(old), F.lit(new))
    if nth < 1:
        raise ValueError("occurrences count from 1")
    parts = F.split(text, _literal(old), -1)
    before = F.array_join(F.slice(parts, 1, nth), old)
    after = F.array_join(F.slice(parts, F.lit(nth + 1), F.greatest(F.size(parts) - nth, F.lit(0))), old)
    return F.when(F.size(parts) > nth, F.concat(before, F.lit(new), after)).otherwise(text)


def substitute_all(text: Column, finds: Sequence[str], replacements: Sequence[str]) -> Column:
    """One replacement after the other, in the given order; empty finds are skipped."""
    if len(finds) != len(replacements):
        raise ValueError("finds and replacements differ in number")
    for old, new in zip(finds, replacements, strict=True):
        text = substitute(text, old, new)
    return text


def template_fill(df: DataFrame, template: str, columns: Sequence[str] | None = None, *, out: str = "filled") -> DataFrame:
    """Adds ``out``: the template with ``{index}`` (from 0) or ``{name}`` (without regard to case) filled from the row, ``{{`` and ``}}`` for braces; unknown tokens stay."""
    names = list(columns or df.columns)
    by_name = {}
    for n in names:
        by_name.setdefault(n.lower(), n)
    parts: list[Column] = []
    for token in re.findall(r"\{\{|\}\}|\{[^}]*\}|[^{}]+|[{}]", template):
        inner = token[1:-1] if token[0] == "{" and token[-1] == "}" else None
        index = int(inner) if inner is not None and re.fullmatch(r"\s*[+-]?[0-9]+\s*", inner) else -1
        if token in ("{{", "}}"):
            parts.append(F.lit(token[0]))
        elif 0 <= index < len(names):
            parts.append(_cell(df, names[index]))
        elif inner is not None and inner.lower() in by_name:
            parts.append(_cell(df, by_name[inner.lower()]))
        else:
            parts.append(F.lit(token))
    return df.withColumn(out, F.concat(*parts) if parts else F.lit(""))


def _cell(df: DataFrame, name: str) -> Column:
    return F.coalesce(to_text(col(name), dtype(df, name)), F.lit(""))
