"""Dates are always measured against an explicit as-of; nothing here reads a clock."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, functions as F

AsOf = date | datetime | str


def to_datetime(as_of: AsOf) -> datetime:
    if isinstance(as_of, datetime):
        return as_of
    if isinstance(as_of, date):
        return datetime(as_of.year, as_of.month, as_of.day)
    return datetime.fromisoformat(as_of)


def stamp(as_of: AsOf) -> Column:
    """Zone-less timestamp literal."""
    return F.lit(to_datetime(as_of).isoformat(sep=" ")).cast("timestamp_ntz")


def day(as_of: AsOf) -> Column:
    return F.lit(to_datetime(as_of).date())


def shifted(as_of: AsOf, days: int) -> date:
    return to_datetime(as_of).date() + timedelta(days=days)


def on_day(col: str | Column, as_of: AsOf) -> Column:
    """A stamp falls on the as-of day, written as a half-open range so the scan can use it."""
    column = F.col(col) if isinstance(col, str) else col
    return (column >= stamp(shifted(as_of, 0))) & (column < stamp(shifted(as_of, 1)))


def since_day(col: str | Column, as_of: AsOf, days_back: int) -> Column:
    """A stamp or date lies on or after the start of (as-of minus days_back); open to the future."""
    column = F.col(col) if isinstance(col, str) else col
    return column >= stamp(shifted(as_of, -days_back))


def in_month(col: str, as_of: AsOf) -> Column:
    """A date lies in the as-of month, as a half-open range."""
    first = to_datetime(as_of).date().replace(day=1)
    following = (first + timedelta(days=32)).replace(day=1)
    return (F.col(col) >= F.lit(first)) & (F.col(col) < F.lit(following))


def completed_years(born: str | Column, as_of: AsOf) -> Column:
    """Whole birthdays passed; 29 February counts from 1 March in common years."""
    b = F.col(born) if isinstance(born, str) else born
    on = to_datetime(as_of)
    birthday_ahead = F.month(b) * 100 + F.dayofmonth(b) > on.month * 100 + on.day
    return F.lit(on.year) - F.year(b) - F.when(birthday_ahead, 1).otherwise(0)


def years_by_days(born: str | Column, as_of: AsOf) -> Column:
    """Days lived divided by 365, rounded down: the simpler age used for cards and plausibility."""
    b = F.col(born) if isinstance(born, str) else born
    return F.floor(F.datediff(day(as_of), b) / F.lit(365)).cast("int")
