"""Period-over-period operators over small per-period aggregates.

The inputs are one row per period (months), a few hundred rows at most, so
the unpartitioned windows here run on a tiny single partition.  Periods are
compared with the previous present period; gaps are not filled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.numeric import percent_of


def with_previous(df: DataFrame, period: str, value: str, name: str) -> DataFrame:
    """``df`` plus ``name`` = LAG(value) OVER (ORDER BY period)."""
    w = Window.orderBy(F.col(period).asc_nulls_first())
    return df.withColumn(name, F.lag(value).over(w))


def period_growth(df: DataFrame, period: str, value: str, previous: str, growth: str,
                  exact=None) -> DataFrame:
    """``df`` plus the previous present period's ``value`` (``previous``) and
    round((value - previous) * 100 / previous, 2) (``growth``); the first
    period has NULLs.  ``exact`` maps a value column to an exact integral
    column (e.g. ``cents`` for money); counts are used as they are."""
    exact = exact or F.col
    lagged = with_previous(df, period, value, previous)
    return lagged.withColumn(growth, percent_of(exact(value) - exact(previous), exact(previous)))


def running_total(df: DataFrame, period: str, value: str, name: str) -> DataFrame:
    """``df`` plus ``name`` = SUM(value) OVER (ORDER BY period) with the
    default RANGE frame (peers included)."""
    w = (Window.orderBy(F.col(period).asc_nulls_first())
         .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(name, F.sum(value).over(w))
