"""Order timing and delivery performance: Q14-Q19, Q41, Q42, Q45-Q48."""

from mercato.reports._common import *  # noqa: F401,F403

ENGLISH = "product_category_name_english"
PURCHASE = "order_purchase_timestamp"
DELIVERED_AT = "order_delivered_customer_date"
ESTIMATED = "order_estimated_delivery_date"


def orders_by_calendar_month(t: Tables) -> DataFrame:
    """Q14: orders per month of the year (all years pooled), by month number."""
    counts = t.orders.groupBy(as_long(F.month(PURCHASE)).alias("month"),
                              month_name(PURCHASE).alias("month_name")) \
        .agg(F.count("order_id").alias("no_of_orders"))
    return counts.orderBy(asc("month"), asc("month_name"))


def busiest_weekday(t: Tables, n: int = 1) -> DataFrame:
    """Q15: the weekday with the most orders."""
    counts = t.orders.groupBy(weekday_name(PURCHASE).alias("weekday")) \
        .agg(F.count("order_id").alias("no_of_orders"))
    return top_n(counts, [desc("no_of_orders"), asc("weekday")], n)


def _delivered(t: Tables) -> DataFrame:
    return facts.delivery_days(t.orders.filter(F.col("order_status") == DELIVERED))


def avg_delivery_days(t: Tables) -> DataFrame:
    """Q16: mean delivery days of delivered orders (undated ones ignored)."""
    return _delivered(t).agg(mean(F.sum("days"), F.count("days")).alias("avg_delivery_time"))


def avg_delivery_days_by_state(t: Tables) -> DataFrame:
    """Q17: mean delivery days per customer state (pre-aggregated per customer)."""
    per_cid = _delivered(t).groupBy("customer_id").agg(
        F.sum("days").alias("_sum"), F.count("days").alias("_n"))
    out = (per_cid.join(t.customers.select("customer_id", "customer_state"), "customer_id")
           .groupBy("customer_state")
           .agg(mean(F.sum("_sum"), F.sum("_n")).alias("avg_delivery_time")))
    return out.orderBy(desc("avg_delivery_time"), asc("customer_state"))


def _seller_delivery(t: Tables) -> DataFrame:
    """Per seller over item rows of delivered orders: day sum, dated rows,
    item rows and distinct orders."""
    rows = t.items.select("order_id", "seller_id").join(
        _delivered(t).select("order_id", "days"), "order_id")
    return rows.groupBy("seller_id").agg(
        mean(F.sum("days"), F.count("days")).alias("avg_delivery_time"),
        F.count("order_id").alias("delivered_rows"),
        F.count_distinct("order_id").alias("delivered_orders_distinct"))


def fastest_sellers(t: Tables, n: int = 10) -> DataFrame:
    """Q18: lowest mean delivery days per seller (item-row weighted); a NULL
    mean sorts first."""
    stats = _seller_delivery(t).select("seller_id", "avg_delivery_time")
    return top_n(stats, [asc("avg_delivery_time"), asc("seller_id")], n)


def _category_delivery(t: Tables, orders: DataFrame) -> DataFrame:
    rows = (t.items.select("order_id", "product_id")
            .join(orders.select("order_id", "days"), "order_id")
            .groupBy("product_id").agg(F.sum("days").alias("_sum"), F.count("days").alias("_n")))
    out = (rows.join(facts.english_categories(t), "product_id").groupBy(ENGLISH)
           .agg(mean(F.sum("_sum"), F.sum("_n")).alias("avg_delivery_time")))
    return out.orderBy(desc("avg_delivery_time"), asc(ENGLISH))


def avg_delivery_days_by_category(t: Tables) -> DataFrame:
    """Q19: mean delivery days per English category, status = delivered."""
    return _category_delivery(t, _delivered(t))


def avg_delivery_days_by_category_any_status(t: Tables) -> DataFrame:
    """Q41: as Q19, but every order with a delivery date, whatever its status."""
    dated = facts.delivery_days(t.orders.filter(F.col(DELIVERED_AT).isNotNull()))
    return _category_delivery(t, dated)


def avg_delivery_days_by_calendar_month(t: Tables) -> DataFrame:
    """Q42: mean delivery days by purchase month of the year (years pooled)."""
    dated = facts.delivery_days(t.orders.filter(F.col(DELIVERED_AT).isNotNull()))
    out = dated.groupBy(as_long(F.month(PURCHASE)).alias("month")).agg(
        mean(F.sum("days"), F.count("days")).alias("avg_delivery_time"))
    return out.orderBy(desc("avg_delivery_time"), asc("month"))


def avg_delay_days_by_state(t: Tables) -> DataFrame:
    """Q45: among delivered orders whose delivery timestamp is after the
    estimate, mean calendar days late per customer state."""
    late = (t.orders.filter((F.col("order_status") == DELIVERED)
                            & (F.col(DELIVERED_AT) > F.col(ESTIMATED)))
            .withColumn("delay", day_diff(DELIVERED_AT, ESTIMATED)))
    per_cid = late.groupBy("customer_id").agg(F.sum("delay").alias("_sum"),
                                              F.count("delay").alias("_n"))
    out = (per_cid.join(t.customers.select("customer_id", "customer_state"), "customer_id")
           .groupBy("customer_state")
           .agg(mean(F.sum("_sum"), F.sum("_n")).alias("avg_delay_days")))
    return out.orderBy(desc("avg_delay_days"), asc("customer_state"))


def top_sellers_by_delivered(t: Tables, min_orders: int = 50, n: int = 10) -> DataFrame:
    """Q46: item rows of delivered orders per seller (shown), among sellers
    with at least ``min_orders`` distinct delivered orders."""
    stats = (_seller_delivery(t).filter(F.col("delivered_orders_distinct") >= min_orders)
             .select("seller_id", F.col("delivered_rows").alias("delivered_orders")))
    return top_n(stats, [desc("delivered_orders"), asc("seller_id")], n)


def fastest_sellers_min_orders(t: Tables, min_orders: int = 50, n: int = 10) -> DataFrame:
    """Q47: as Q18 among sellers with at least ``min_orders`` distinct
    delivered orders."""
    stats = (_seller_delivery(t).filter(F.col("delivered_orders_distinct") >= min_orders)
             .select("seller_id", "avg_delivery_time"))
    return top_n(stats, [asc("avg_delivery_time"), asc("seller_id")], n)


def monthly_delay_rate(t: Tables) -> DataFrame:
    """Q48: per (year, month) of delivered orders, distinct late orders as a
    percentage of distinct orders.  Orders are first reduced to one row per
    (year, month, order), so both distinct counts become plain counts."""
    d = t.orders.filter(F.col("order_status") == DELIVERED)
    per_order = (d.groupBy(as_long(F.year(PURCHASE)).alias("year"),
                           as_long(F.month(PURCHASE)).alias("month"), "order_id")
                 .agg(F.max(F.col(DELIVERED_AT) > F.col(ESTIMATED)).alias("late")))
    per_month = per_order.groupBy("year", "month").agg(
        F.count("order_id").alias("_all"),
        F.count(F.when(F.col("late"), F.col("order_id"))).alias("_late"))
    return (per_month.select("year", "month",
                             percent_of("_late", "_all")
                             .alias("delayed_percentage"))
            .orderBy(desc("delayed_percentage"), asc("year"), asc("month")))
