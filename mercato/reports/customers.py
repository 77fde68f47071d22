"""Customers: Q22, Q23, Q34, Q44, Q50."""

from mercato.reports._common import *  # noqa: F401,F403

PURCHASE = "order_purchase_timestamp"


def orders_per_customer(t: Tables) -> DataFrame:
    """Q22: orders per customer_id, all customers."""
    out = t.orders.groupBy("customer_id").agg(F.count("order_id").alias("order_count"))
    return out.orderBy(desc("order_count"), asc("customer_id"))


def aov_per_customer(t: Tables, n: int = 10) -> DataFrame:
    """Q23: mean order total per customer_id, top n."""
    per_cid = (facts.order_totals(t).join(t.orders.select("order_id", "customer_id"), "order_id")
               .groupBy("customer_id")
               .agg(mean(F.sum("order_total"), F.count("order_total")).alias("avg_order_value")))
    return top_n(per_cid, [desc("avg_order_value"), asc("customer_id")], n)


def top_customers_by_distinct_sellers(t: Tables, n: int = 10) -> DataFrame:
    """Q34: distinct sellers per customer_id, top n."""
    rows = t.orders.select("order_id", "customer_id").join(
        t.items.select("order_id", "seller_id"), "order_id")
    counts = rows.groupBy("customer_id").agg(F.count_distinct("seller_id").alias("seller_count"))
    return top_n(counts, [desc("seller_count"), asc("customer_id")], n)


def avg_items_per_order_by_customer(t: Tables, min_orders: int = 5) -> DataFrame:
    """Q44: item rows per (customer, order), their mean per customer_id, for
    customers with at least ``min_orders`` distinct orders.  Items are counted
    per order before the join; grouping by (order_id, customer_id) right after
    the join on order_id reuses its partitioning (no extra shuffle)."""
    per_order = t.items.groupBy("order_id").agg(F.count("order_item_id").alias("_items"))
    totals = (per_order.join(t.orders.select("order_id", "customer_id"), "order_id")
              .groupBy("order_id", "customer_id").agg(F.sum("_items").alias("total")))
    out = (totals.groupBy("customer_id")
           .agg(mean(F.sum("total"), F.count("total")).alias("avg_items"),
                F.count_distinct("order_id").alias("_orders"))
           .filter(F.col("_orders") >= min_orders)
           .select("customer_id", "avg_items"))
    return out.orderBy(desc("avg_items"), asc("customer_id"))


def purchase_gap(t: Tables, min_orders: int = 2) -> DataFrame:
    """Q50: per person (customer_unique_id) first and last purchase and the
    day gap, for persons with at least ``min_orders`` orders."""
    per_cid = t.orders.groupBy("customer_id").agg(
        F.min(PURCHASE).alias("_first"), F.max(PURCHASE).alias("_last"),
        F.count("order_id").alias("_orders"))
    per_person = (per_cid.join(t.customers.select("customer_id", "customer_unique_id"),
                               "customer_id")
                  .groupBy("customer_unique_id")
                  .agg(F.min("_first").alias("first_purchase"),
                       F.max("_last").alias("last_purchase"),
                       F.sum("_orders").alias("_orders"))
                  .filter(F.col("_orders") >= min_orders))
    out = per_person.select("customer_unique_id", "first_purchase", "last_purchase",
                            as_long(day_diff("last_purchase", "first_purchase"))
                            .alias("purchase_gap"))
    return out.orderBy(desc("purchase_gap"), asc("customer_unique_id"))
