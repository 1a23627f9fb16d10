"""Next occurrence of a cron expression of five fields, or six with seconds first."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_DAYS = "sun mon tue wed thu fri sat".split()


def _field(text: str, low: int, high: int, names: list[str], base: int) -> set[int]:
    def number(x: str) -> int:
        n = names.index(x.lower()) + base if x.lower() in names else int(x)
        if not low <= n <= high:
            raise ValueError(f"{x} is not within {low} to {high}")
        return n

    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        if step and int(step) < 1:
            raise ValueError(f"step of {part!r}")
        if span == "*":
            a, b = low, high
        elif "-" in span:
            a, b = map(number, span.split("-", 1))
        else:
            a = number(span)
            b = high if step else a
        if a > b:
            raise ValueError(f"empty range {span!r}")
        out |= set(range(a, b + 1, int(step or 1)))
    return out


class Schedule:
    """A day matches if it matches both fields, or either one where both are restricted (the usual cron reading)."""

    def __init__(self, expression: str):
        parts = expression.split()
        if len(parts) not in (5, 6):
            raise ValueError("a schedule has five fields, or six with seconds")
        second, minute, hour, day, month, weekday = parts if len(parts) == 6 else ["0", *parts]
        self.seconds = sorted(_field(second, 0, 59, [], 0))
        self.minutes = sorted(_field(minute, 0, 59, [], 0))
        self.hours = sorted(_field(hour, 0, 23, [], 0))
        self.days, self.months = _field(day, 1, 31, [], 1), _field(month, 1, 12, _MONTHS, 1)
        self.weekdays = {x % 7 for x in _field(weekday, 0, 7, _DAYS, 0)}
        self.either = day != "*" and weekday != "*"

    def _on(self, t: datetime) -> bool:
        a, b = t.day in self.days, (t.weekday() + 1) % 7 in self.weekdays
        return t.month in self.months and (a or b if self.either else a and b)

    def next_after(self, t: datetime, years: int = 9) -> datetime | None:
        """The first occurrence strictly after ``t``, or None if there is none for some years."""
        t = t.replace(microsecond=0) + timedelta(seconds=1)
        day = t.replace(hour=0, minute=0, second=0)
        for _ in range(366 * years):
            if self._on(day):
                for h in self.hours:
                    for m in self.minutes:
                        for s in self.seconds:
                            at = day.replace(hour=h, minute=m, second=s)
                            if at >= t:
                                return at
            day += timedelta(days=1)
        return None


def next_after(expression: str):
    """A pandas UDF: timestamps to the next occurrence of ``expression``."""
    schedule = Schedule(expression)

    @F.pandas_udf("timestamp")
    def run(times: pd.Series) -> pd.Series:
        return times.map(lambda t: pd.NaT if pd.isna(t) else schedule.next_after(t.to_pydatetime()))

    return run
