"""Month arithmetic on dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_end(c: Column) -> Column:
    return F.last_day(F.to_date(c))


def next_month_end(c: Column, months: int = 1) -> Column:
    """Month-end ``months`` later; also from a month-end in a shorter month."""
    return F.last_day(F.add_months(F.to_date(c), months))


def holding_date(c: Column) -> Column:
    """First day of the month after a formation month-end."""
    return F.trunc(F.add_months(F.to_date(c), 1), "MM").cast("date")


def month_index(c: Column) -> Column:
    """Calendar month number; only differences mean anything."""
    return F.year(c) * 12 + F.month(c)


def period_index(c: Column, period: str = "month") -> Column:
    """Number of a month or of a day, for trailing windows at either grain."""
    if period == "month":
        return month_index(c)
    if period == "day":
        return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    raise ValueError(f"period: {period}")
