"""Sales and revenue: Q6-Q13, Q28-Q32, Q51."""

from mercato.reports._common import *  # noqa: F401,F403

ENGLISH = "product_category_name_english"


def average_order_value(t: Tables) -> DataFrame:
    """Q6: mean of per-order payment totals, rounded to 2."""
    totals = facts.order_totals(t)
    agg = totals.agg(F.sum("order_total").alias("_sum"), F.count("order_total").alias("_n"))
    return agg.select(rounded_ratio(cents("_sum"), F.col("_n") * 100).alias("avg_order_value"))


def _product_price_stats(t: Tables) -> DataFrame:
    """Per product_id: price sum, priced rows, rows with a product (map-side
    combined before the products join)."""
    return t.items.groupBy("product_id").agg(
        F.sum("price").alias("price_sum"), F.count("price").alias("price_n"),
        F.count("product_id").alias("units"))


def _category_price_stats(t: Tables) -> DataFrame:
    return (_product_price_stats(t).join(facts.english_categories(t), "product_id")
            .groupBy(ENGLISH).agg(F.sum("price_sum").alias("price_sum"),
                                  F.sum("price_n").alias("price_n"),
                                  F.sum("units").alias("units")))


def category_revenue(t: Tables) -> DataFrame:
    """English category, total_revenue (exact decimal)."""
    return _category_price_stats(t).select(ENGLISH, F.col("price_sum").alias("total_revenue"))


def top_categories_by_revenue(t: Tables, n: int = 10) -> DataFrame:
    """Q7: SUM(price) per English category, top n."""
    top = top_n(category_revenue(t), [desc("total_revenue"), asc(ENGLISH)], n)
    return top.select(ENGLISH, as_double("total_revenue").alias("total_revenue"))


def top_customers_by_spend(t: Tables, n: int = 10) -> DataFrame:
    """Q8: SUM(payment_value) per customer_id, top n."""
    spend = facts.spend_per_customer_id(t)
    top = top_n(spend, [desc("spend"), asc("customer_id")], n)
    return top.select("customer_id", as_double("spend").alias("money_spent"))


def top_sellers_by_revenue(t: Tables, n: int = 10) -> DataFrame:
    """Q9: SUM(price) per seller, top n."""
    rev = t.items.groupBy("seller_id").agg(F.sum("price").alias("total_revenue"))
    top = top_n(rev, [desc("total_revenue"), asc("seller_id")], n)
    return top.select("seller_id", as_double("total_revenue").alias("total_revenue"))


def top_states_by_sales(t: Tables, n: int = 10) -> DataFrame:
    """Q10: SUM(payment_value) per customer state, top n."""
    sales = facts.spend_by(t, ["customer_state"])
    top = top_n(sales, [desc("total_spending"), asc("customer_state")], n)
    return top.select("customer_state", as_double("total_spending").alias("total_sales"))


def top_categories_by_avg_price(t: Tables, n: int = 10) -> DataFrame:
    """Q11: AVG(price) over item rows per English category, top n."""
    avg = _category_price_stats(t).select(ENGLISH, mean("price_sum", "price_n").alias("avg_sp"))
    return top_n(avg, [desc("avg_sp"), asc(ENGLISH)], n)


def top_categories_by_units(t: Tables, n: int = 10) -> DataFrame:
    """Q12: item rows per English category, top n."""
    units = _category_price_stats(t).select(ENGLISH, F.col("units").alias("units_sold"))
    return top_n(units, [desc("units_sold"), asc(ENGLISH)], n)


def top_sellers_by_units(t: Tables, n: int = 10) -> DataFrame:
    """Q13: COUNT(product_id) per seller, top n."""
    units = t.items.groupBy("seller_id").agg(F.count("product_id").alias("units_sold"))
    return top_n(units, [desc("units_sold"), asc("seller_id")], n)


def _orders_with_totals(t: Tables) -> DataFrame:
    return facts.order_totals(t).join(
        t.orders.select("order_id", "customer_id", "order_purchase_timestamp"), "order_id")


def _calendar_keys(ts: str = "order_purchase_timestamp"):
    return [as_long(F.year(ts)).alias("year"), as_long(F.month(ts)).alias("month"),
            month_name(ts).alias("month_name")]


def monthly_sales(t: Tables) -> DataFrame:
    """Q28: SUM(payment_value) by (year, month)."""
    sales = (_orders_with_totals(t).groupBy(*_calendar_keys())
             .agg(F.sum("order_total").alias("sales_amount")))
    return (sales.select("year", "month", "month_name",
                         as_double("sales_amount").alias("sales_amount"))
            .orderBy(desc("sales_amount"), asc("year"), asc("month")))


def monthly_aov(t: Tables) -> DataFrame:
    """Q29: mean order total by (year, month)."""
    aov = (_orders_with_totals(t).groupBy(*_calendar_keys())
           .agg(mean(F.sum("order_total"), F.count("order_total")).alias("avg_order_value")))
    return aov.orderBy(desc("avg_order_value"), asc("year"), asc("month"))


def aov_by_state(t: Tables) -> DataFrame:
    """Q31: mean order total per customer state (sum and count pre-aggregated
    per customer_id before the customers join)."""
    per_cid = (_orders_with_totals(t).groupBy("customer_id")
               .agg(F.sum("order_total").alias("_sum"), F.count("order_total").alias("_n")))
    per_state = (per_cid.join(t.customers.select("customer_id", "customer_state"), "customer_id")
                 .groupBy("customer_state")
                 .agg(mean(F.sum("_sum"), F.sum("_n")).alias("avg_order_value")))
    return per_state.orderBy(desc("avg_order_value"), asc("customer_state"))


def avg_category_revenue_per_order(t: Tables) -> DataFrame:
    """Q32: price sum per (raw category, order), then its mean per English
    category (aggregated before the translation join, as written).  A product
    has a row for each of its items when it meets its category: a best-seller
    is dealt out.  Items are not summed by product and order first, nor in the
    tasks that read them: that hardly merges any, and a task would hold a table
    of all rows of its input split.  They are dealt out by category and order
    over all shuffle partitions, which are not merged into larger ones."""
    items = t.items.select("product_id", "order_id", "order_item_id", "price")
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cat_orders = (skew_join(items, t.products.select("product_id", "product_category_name"),
                            "product_id", ["order_id", "order_item_id"])
                  .repartition(parts, "product_category_name", "order_id")
                  .groupBy("product_category_name", "order_id")
                  .agg(F.sum("price").alias("cat_revenue")))
    per_cat = (cat_orders.groupBy("product_category_name")
               .agg(F.sum("cat_revenue").alias("_sum"), F.count("cat_revenue").alias("_n")))
    out = (per_cat.join(t.translation, "product_category_name")
           .groupBy(ENGLISH).agg(mean(F.sum("_sum"), F.sum("_n")).alias("avg_revenue")))
    return out.orderBy(desc("avg_revenue"), asc(ENGLISH))


def state_revenue_share(t: Tables) -> DataFrame:
    """Q51: state revenue, the total of ALL payments (joined or not) and the
    state's percentage of it."""
    states = facts.spend_by(t, ["customer_state"])
    total = t.payments.agg(F.sum("payment_value")).scalar()  # scalar subquery, projected once
    return (states.withColumn("_total", total)
            .select("customer_state",
                    as_double("total_spending").alias("state_revenue"),
                    as_double("_total").alias("total_revenue"),
                    percent_of(cents("total_spending"), cents("_total"))
                    .alias("percentage_contribution"))
            .orderBy(desc("percentage_contribution"), asc("customer_state")))
