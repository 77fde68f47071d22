"""Sellers and seller-customer relations: Q24, Q33, Q35, Q36, Q40, Q43."""

from mercato.reports._common import *  # noqa: F401,F403

ENGLISH = "product_category_name_english"


def aov_per_seller_as_written(t: Tables, n: int = 10) -> DataFrame:
    """Q24, keeping the source's join on order_id only: every item row of a
    seller in an order meets the (seller, order) totals of ALL sellers of that
    order.  Per (order, seller): item rows and price sum (combined map-side);
    per order: the sum and count of non-NULL totals, an aggregate joined back
    (not a window, so an order with very many sellers is combined map-side
    and its join can be split by AQE); per seller:
    sum(rows x order sum) / sum(rows x count)."""
    per_pair = (t.items.filter(F.col("order_id").isNotNull())
                .groupBy("order_id", "seller_id")
                .agg(F.count(F.lit(1)).alias("_rows"), F.sum("price").alias("_total")))
    per_order = per_pair.groupBy("order_id").agg(
        F.sum("_total").alias("_osum"), F.count("_total").alias("_on"))
    weighted = per_pair.join(per_order, "order_id")
    out = weighted.groupBy("seller_id").agg(
        mean(F.sum(F.col("_rows") * F.col("_osum")), F.sum(F.col("_rows") * F.col("_on")))
        .alias("avg_order_value"))
    return top_n(out, [desc("avg_order_value"), asc("seller_id")], n)


def top_sellers_by_orders(t: Tables, n: int = 10) -> DataFrame:
    """Q33: distinct orders per seller, top n."""
    counts = t.items.groupBy("seller_id").agg(F.count_distinct("order_id").alias("order_count"))
    return top_n(counts, [desc("order_count"), asc("seller_id")], n)


def top_sellers_by_category_breadth(t: Tables, n: int = 10) -> DataFrame:
    """Q35: distinct raw categories per seller (NULL not counted), top n."""
    rows = t.items.select("seller_id", "product_id").distinct().join(
        t.products.select("product_id", "product_category_name"), "product_id")
    counts = rows.groupBy("seller_id").agg(
        F.count_distinct("product_category_name").alias("product_cat_count"))
    return top_n(counts, [desc("product_cat_count"), asc("seller_id")], n)


def top_categories_by_distinct_customers(t: Tables, n: int = 10) -> DataFrame:
    """Q36: distinct customer_ids per English category, top n.  The customers
    of a best-seller are dealt out when they meet its category."""
    pairs = (t.items.select("order_id", "product_id")
             .join(t.orders.select("order_id", "customer_id"), "order_id")
             .select("product_id", "customer_id").distinct())
    rows = skew_join(pairs, facts.english_categories(t), "product_id", ["customer_id"], weights=t.items)
    counts = rows.groupBy(ENGLISH).agg(F.count_distinct("customer_id").alias("customer_count"))
    return top_n(counts, [desc("customer_count"), asc(ENGLISH)], n)


def top_sellers_by_freight(t: Tables, n: int = 10) -> DataFrame:
    """Q40: SUM(freight_value) per seller, top n."""
    sums = t.items.groupBy("seller_id").agg(F.sum("freight_value").alias("_freight"))
    top = top_n(sums, [desc("_freight"), asc("seller_id")], n)
    return top.select("seller_id", as_double("_freight").alias("shipping_charges"))


def avg_freight_per_order_by_seller(t: Tables, min_orders: int = 50, n: int = 10) -> DataFrame:
    """Q43: freight per (seller, order), its mean per seller, for sellers with
    at least ``min_orders`` distinct orders, top n.  After the first level
    each (seller, order) is one row, so COUNT(order_id) is the distinct count."""
    per_order = t.items.groupBy("seller_id", "order_id").agg(
        F.sum("freight_value").alias("total_freight"))
    out = (per_order.groupBy("seller_id")
           .agg(mean(F.sum("total_freight"), F.count("total_freight")).alias("avg_freight"),
                F.count("order_id").alias("_orders"))
           .filter(F.col("_orders") >= min_orders)
           .select("seller_id", "avg_freight"))
    return top_n(out, [desc("avg_freight"), asc("seller_id")], n)
