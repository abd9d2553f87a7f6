"""Calendar days and instants in UTC, and functions of them on terms of typed queries."""

from __future__ import annotations

from datetime import date, datetime, time, timezone

from pyspark.sql import Column, functions as F

from ..terms import Applied, Term


def parse_time(x: datetime | date | str) -> datetime:
    """An instant from a datetime (naive ones are UTC), a date (its midnight) or ISO text; kept to the millisecond."""
    if isinstance(x, str):
        x = datetime.fromisoformat(x.strip())
    if not isinstance(x, datetime):
        x = datetime.combine(x, time())
    x = x.replace(tzinfo=timezone.utc) if x.tzinfo is None else x.astimezone(timezone.utc)
    return x.replace(microsecond=x.microsecond // 1000 * 1000)


def iso(x: datetime | date) -> str:
    """ISO text: a day, or an instant with milliseconds and Z."""
    return parse_time(x).isoformat(timespec="milliseconds").replace("+00:00", "Z") if isinstance(x, datetime) else x.isoformat()


def _on(name: str, change, t, *args):
    """The function on a term of a typed query or, for collection queries, on a Column or field of one class."""
    if isinstance(t, Term):
        return Applied(name, change, t, *args)
    return change(t if isinstance(t, Column) else t.column, *args)


def year(t):
    return _on("year", F.year, t)


def month(t):
    return _on("month", F.month, t)


def day(t):
    """The day of the month."""
    return _on("day", F.dayofmonth, t)


def day_at(t):
    """The day, in UTC, on which an instant falls."""
    return _on("day_at", F.to_date, t)


def plus_days(t, n: int):
    return _on("plus_days", F.date_add, t, n)
