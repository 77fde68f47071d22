"""Business overview: Q1-Q5."""

from mercato.reports._common import *  # noqa: F401,F403


def entity_counts(t: Tables) -> dict[str, DataFrame]:
    """Q1: five one-row counts (COUNT of each table's key column)."""
    return {
        "total_customers": t.customers.agg(F.count("customer_id").alias("total_customers")),
        "total_sellers": t.sellers.agg(F.count("seller_id").alias("total_sellers")),
        "total_products": t.products.agg(F.count("product_id").alias("total_products")),
        "total_orders": t.orders.agg(F.count("order_id").alias("total_orders")),
        "total_categories": t.translation.agg(
            F.count("product_category_name").alias("total_categories")),
    }


def dataset_period(t: Tables) -> DataFrame:
    """Q2: first and last purchase date and the span in years (days / 365)."""
    ts = "order_purchase_timestamp"
    span = t.orders.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return span.select(F.to_date("first_ts").alias("first_date"),
                       F.to_date("last_ts").alias("last_date"),
                       rounded_ratio(day_diff("last_ts", "first_ts"), F.lit(DAYS_PER_YEAR))
                       .alias("time_period_yrs"))


def order_status_distribution(t: Tables) -> DataFrame:
    """Q3: orders per status and their percentage of all orders."""
    counts = t.orders.groupBy("order_status").agg(F.count("order_id").alias("order_count"))
    total = t.orders.agg(F.count(F.lit(1))).scalar()  # scalar subquery, projected once
    return (counts.withColumn("_all", total)
            .select("order_status", "order_count",
                    percent_of("order_count", "_all").alias("order_percentage"))
            .orderBy(desc("order_percentage"), asc("order_status")))


def top_categories_by_product_count(t: Tables, n: int = 10) -> DataFrame:
    """Q4: products per English category, top n."""
    counts = (facts.english_categories(t).groupBy("product_category_name_english")
              .agg(F.count("product_id").alias("product_count")))
    return top_n(counts, [desc("product_count"), asc("product_category_name_english")], n)


def top_sellers_by_unique_products(t: Tables, n: int = 10) -> DataFrame:
    """Q5: distinct products per seller, top n."""
    counts = t.items.groupBy("seller_id").agg(
        F.count_distinct("product_id").alias("unique_products"))
    return top_n(counts, [desc("unique_products"), asc("seller_id")], n)
