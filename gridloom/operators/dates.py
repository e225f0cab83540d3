"""Working-day arithmetic."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import col

WEEKEND = "0000011"


def workday_add(df: DataFrame, start: str, days: str | int, mask: str = WEEKEND, holidays: Sequence[dt.date] = (), *, out: str = "workday") -> DataFrame:
    """Adds ``days`` working days (back if negative) to a date; 0 leaves it as it is, also on a day off.

    ``mask`` marks the days off from Monday to Sunday by 1. The date is computed, not looked up: whole weeks by arithmetic, the rest by
    the day's row in a table of 7 weekdays, holidays by their sorted list; no calendar is joined and nothing is shuffled.
    """
    if len(mask) != 7 or set(mask) - {"0", "1"} or mask == "1111111":
        raise ValueError("the mask has seven 0 or 1, and not seven 1")
    on = [m == "0" for m in mask]
    per_week = sum(on)
    off = sorted({h for h in holidays if on[h.weekday()]})
    # Working days before day w of a week, and for the k-th working day of a week its weekday.
    before = [sum(on[:w]) for w in range(8)]
    kth = [w for w in range(7) if on[w]]
    day = col(start).cast("date")
    n = (col(days) if isinstance(days, str) else F.lit(days)).cast("bigint")
    # Day numbers from a Monday on.
    monday = F.unix_date(day) - 4
    array = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i.cast("int") + 1)

    def index(d: Column) -> Column:
        """Working days (holidays counted in) before day number d."""
        return F.floor(d / 7) * per_week + array(before, F.pmod(d, F.lit(7)))

    def nth(i: Column) -> Column:
        """The day number of the working day with index i."""
        return F.floor(i / per_week) * 7 + array(kth, F.pmod(i, F.lit(per_week)))

    numbers = [(h - dt.date(1970, 1, 5)).days for h in off]
    places = [x // 7 * per_week + before[x % 7] for x in numbers]
    # Of n days on from the start: target = first index on or after the start that is passed, moved by the holidays passed.
    free = F.lit(0)
    if places:
        # Index of the working days when holidays are taken out: a holiday at place p moves all later ones by one.
        gaps = [p - i for i, p in enumerate(places)]
        holidays_before = lambda i: F.size(F.filter(F.array(*[F.lit(p) for p in places]), lambda p: p < i))
        moved = lambda i: i + F.size(F.filter(F.array(*[F.lit(g) for g in gaps]), lambda g: g <= i))
    else:
        holidays_before, moved = (lambda i: free), (lambda i: i)
    working = array(on, F.pmod(monday, F.lit(7))) & ~monday.isin(numbers) if numbers else array(on, F.pmod(monday, F.lit(7)))
    here = index(monday)
    clean = here - holidays_before(here)  # working days before the start
    target = F.when(n > 0, clean + n - F.when(working, 0).otherwise(1)).otherwise(clean + n)
    result = F.date_from_unix_date((nth(moved(target)) + 4).cast("int"))
    return df.withColumn(out, F.when(n == 0, day).otherwise(result))
