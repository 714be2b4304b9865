"""Calendar-month expressions. Months are half-open and evaluated in the session time zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_bounds(as_of: dt.date) -> tuple[dt.date, dt.date]:
    """First day of the month of ``as_of`` and first day of the next month."""
    first = dt.date(as_of.year, as_of.month, 1)
    following = dt.date(as_of.year + as_of.month // 12, as_of.month % 12 + 1, 1)
    return first, following


def in_month(column, as_of: dt.date) -> Column:
    """Half-open month test on the raw column, so that it reaches the Parquet scan."""
    value = F.col(column) if isinstance(column, str) else column
    first, following = month_bounds(as_of)
    return (value >= F.lit(first)) & (value < F.lit(following))


def month_label(as_of: dt.date) -> Column:
    return F.date_format(F.lit(month_bounds(as_of)[0]), "MMMM yyyy")


def date_time_text(column) -> Column:
    return F.date_format(column, "dd.MM.yy, HH:mm")


def day_number(column) -> Column:
    """Calendar day as the integer yyyymmdd."""
    value = F.col(column) if isinstance(column, str) else column
    return F.year(value) * 10000 + F.month(value) * 100 + F.dayofmonth(value)
