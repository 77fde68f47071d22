"""Imports and small conventions shared by the report modules.

Output conventions (fixed so results compare across engines): counts,
ranks, years, months and day differences are bigint; money and means are
double, converted from exact decimal sums in the last projection; rounded
values come from ``rounded_ratio`` (exact, half away from zero).
Ties at a LIMIT are cut by the entity key, ascending.
"""

from pyspark.sql import DataFrame, Window  # noqa: F401
from pyspark.sql import functions as F  # noqa: F401

from mercato.functions import (as_double, as_long, cents, day_diff, mean, month_name,  # noqa: F401
                               month_start, percent_of, rounded_ratio, weekday_name,
                               year_month)
from mercato.operators.ranking import (dense_rank_at_most, group_dense_rank,  # noqa: F401
                                       lag_by_position, latest_per_key, scalable_ntile, top_n)
from mercato.plans import facts  # noqa: F401
from mercato.plans.dimension import dimension_join  # noqa: F401
from mercato.plans.skew import skew_join  # noqa: F401
from mercato.sources.model import Tables  # noqa: F401

# These must equal the report definitions for right results.
DELIVERED = "delivered"  # order_status of completed orders
DELAYED = "Delayed"  # Q49 label: delivered after the estimated date
ON_TIME = "On-Time"  # Q49 label: everything else
DAYS_PER_YEAR = 365  # Q2 divides the day span by 365


def desc(col: str):
    return F.col(col).desc_nulls_last()


def asc(col: str):
    return F.col(col).asc_nulls_first()
