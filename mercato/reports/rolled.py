"""Reports answered from rollups kept by month (``plans.rollups``).

Each function takes (spark, path of the rollups) and returns what the report of
the same key returns from the tables; ``ROLLED`` maps the keys.
"""

from collections.abc import Callable

from pyspark.sql import SparkSession

from mercato.operators.timeseries import period_growth, running_total
from mercato.plans.rollups import ENGLISH, merged
from mercato.reports._common import *  # noqa: F401,F403
from mercato.sources.monthly import MONTH


def _top(name: str, key: str, measure: Callable, shown: str, show: Callable = F.col, n: int = 10):
    """The first ``n`` keys by ``measure()``, which is shown as ``show`` of it."""
    def report(spark: SparkSession, path: str) -> DataFrame:
        rows = merged(spark, path, name).select(key, measure().alias("_m"))
        return top_n(rows, [desc("_m"), asc(key)], n).select(key, show("_m").alias(shown))
    return report


def _money(name: str, key: str, measure: str, shown: str):
    return _top(name, key, lambda: F.col(measure), shown, as_double)


def _count(name: str, key: str, measure: str, shown: str):
    return _top(name, key, lambda: F.col(measure), shown)


def _distinct(name: str, key: str, counted: str, shown: str, n: int = 10):
    """The first ``n`` keys by their number of distinct ``counted`` (not NULL)."""
    def report(spark: SparkSession, path: str) -> DataFrame:
        counts = merged(spark, path, name).groupBy(key).agg(F.count(counted).alias(shown))
        return top_n(counts, [desc(shown), asc(key)], n)
    return report


def _ranked_categories(spark: SparkSession, path: str) -> DataFrame:
    rank = F.dense_rank().over(Window.orderBy(desc("price_sum")))  # one row a category
    return merged(spark, path, "category").select(
        ENGLISH, as_double("price_sum").alias("total_revenue"), as_long(rank).alias("revenue_rank"))


def _aov_by_state(spark: SparkSession, path: str) -> DataFrame:
    rows = merged(spark, path, "state").select("customer_state", mean("paid", "paid_orders").alias("avg_order_value"))
    return rows.orderBy(desc("avg_order_value"), asc("customer_state"))


def _state_share(spark: SparkSession, path: str) -> DataFrame:
    total = merged(spark, path, "month").select("payments").scalar()
    rows = merged(spark, path, "state").withColumn("_total", total)
    return rows.select("customer_state", as_double("paid").alias("state_revenue"),
                       as_double("_total").alias("total_revenue"),
                       percent_of(cents("paid"), cents("_total")).alias("percentage_contribution")
                       ).orderBy(desc("percentage_contribution"), asc("customer_state"))


def _months(spark: SparkSession, path: str, measure: str) -> DataFrame:
    """MONTH and the measures of the months that have orders of the kind."""
    return merged(spark, path, "month", by_month=True).where(F.col(measure) > 0)


def _calendar() -> list:
    day = F.to_date(F.concat(MONTH, F.lit("-01")))
    return [as_long(F.year(day)).alias("year"), as_long(F.month(day)).alias("month"), month_name(day).alias("month_name")]


def _monthly_sales(spark: SparkSession, path: str) -> DataFrame:
    rows = _months(spark, path, "paid_orders").select(*_calendar(), as_double("paid").alias("sales_amount"))
    return rows.orderBy(desc("sales_amount"), asc("year"), asc("month"))


def _monthly_aov(spark: SparkSession, path: str) -> DataFrame:
    rows = _months(spark, path, "paid_orders").select(*_calendar(), mean("paid", "paid_orders").alias("avg_order_value"))
    return rows.orderBy(desc("avg_order_value"), asc("year"), asc("month"))


def _revenue(spark: SparkSession, path: str) -> DataFrame:
    return _months(spark, path, "paid_orders").select(F.col(MONTH).alias("yearmonth"), F.col("paid").alias("revenue"))


def _revenue_growth(spark: SparkSession, path: str) -> DataFrame:
    rows = period_growth(_revenue(spark, path), "yearmonth", "revenue", "prev_month_revenue", "growth_rate", exact=cents)
    return rows.select("yearmonth", as_double("revenue").alias("revenue"),
                       as_double("prev_month_revenue").alias("prev_month_revenue"), "growth_rate")


def _order_growth(spark: SparkSession, path: str) -> DataFrame:
    rows = _months(spark, path, "orders").select(F.col(MONTH).alias("yearmonth"), F.col("orders").alias("month_orders"))
    return period_growth(rows, "yearmonth", "month_orders", "prev_month_orders", "growth_rate")


def _cumulative_revenue(spark: SparkSession, path: str) -> DataFrame:
    rows = running_total(_revenue(spark, path), "yearmonth", "revenue", "cumulative_revenue")
    return rows.select("yearmonth", as_double("revenue").alias("monthly_revenue"),
                       as_double("cumulative_revenue").alias("cumulative_revenue")).orderBy(asc("yearmonth"))


ROLLED = {
    "q05_top_sellers_by_unique_products": _distinct("seller_products", "seller_id", "product_id", "unique_products"),
    "q07_top_categories_by_revenue": _money("category", ENGLISH, "price_sum", "total_revenue"),
    "q09_top_sellers_by_revenue": _money("seller", "seller_id", "price_sum", "total_revenue"),
    "q10_top_states_by_sales": _money("state", "customer_state", "paid", "total_sales"),
    "q11_top_categories_by_avg_price": _top("category", ENGLISH, lambda: mean("price_sum", "price_n"), "avg_sp"),
    "q12_top_categories_by_units": _count("category", ENGLISH, "units", "units_sold"),
    "q13_top_sellers_by_units": _count("seller", "seller_id", "units", "units_sold"),
    "q28_monthly_sales": _monthly_sales,
    "q29_monthly_aov": _monthly_aov,
    "q31_aov_by_state": _aov_by_state,
    "q33_top_sellers_by_orders": _count("seller", "seller_id", "orders", "order_count"),
    "q34_top_customers_by_distinct_sellers": _distinct("customer_sellers", "customer_id", "seller_id", "seller_count"),
    "q35_top_sellers_by_category_breadth": _distinct(
        "seller_categories", "seller_id", "product_category_name", "product_cat_count"),
    "q36_top_categories_by_distinct_customers": _distinct("category_customers", ENGLISH, "customer_id", "customer_count"),
    "q40_top_sellers_by_freight": _money("seller", "seller_id", "freight", "shipping_charges"),
    "q51_state_revenue_share": _state_share,
    "q52_rank_categories_by_revenue": _ranked_categories,
    "q55_monthly_revenue_growth": _revenue_growth,
    "q56_monthly_order_growth": _order_growth,
    "q61_cumulative_monthly_revenue": _cumulative_revenue,
}
