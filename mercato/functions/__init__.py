"""Column-level building blocks (built-in Spark expressions only)."""

from mercato.functions.dates import day_diff, month_name, month_start, weekday_name, year_month
from mercato.functions.numeric import (as_double, as_long, cents, mean, percent_of,
                                      rounded_ratio)

__all__ = ["day_diff", "month_name", "month_start", "weekday_name", "year_month",
           "as_double", "as_long", "cents", "mean", "percent_of", "rounded_ratio"]
