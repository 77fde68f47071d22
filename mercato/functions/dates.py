"""Calendar expressions with the report semantics.

Month and weekday names are full English names ('January', 'Sunday');
``F.monthname`` / ``F.dayname`` give abbreviations, so patterns are used.
Day differences count calendar days between the date parts, so one second
across midnight is one day.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Output formats the reports define.
MONTH_NAME_PATTERN = "MMMM"  # full English month name, e.g. 'January'
WEEKDAY_NAME_PATTERN = "EEEE"  # full English weekday name, e.g. 'Sunday'
YEAR_MONTH_PATTERN = "yyyy-MM"  # e.g. '2018-01'


def _c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


def month_name(ts: ColumnOrName) -> Column:
    return F.date_format(_c(ts), MONTH_NAME_PATTERN)


def weekday_name(ts: ColumnOrName) -> Column:
    return F.date_format(_c(ts), WEEKDAY_NAME_PATTERN)


def year_month(ts: ColumnOrName) -> Column:
    """'yyyy-MM' label of a timestamp."""
    return F.date_format(_c(ts), YEAR_MONTH_PATTERN)


def month_start(ts: ColumnOrName) -> Column:
    """Midnight of the first day of the timestamp's month."""
    return F.date_trunc("month", _c(ts))


def day_diff(end: ColumnOrName, start: ColumnOrName) -> Column:
    """Calendar days from ``start`` to ``end`` (date parts only)."""
    return F.datediff(F.to_date(_c(end)), F.to_date(_c(start)))
