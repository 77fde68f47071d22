"""Shared intermediate results (the report SQL repeats them as CTE text).

Each is aggregated by the key of the join that follows, before the join:
Catalyst does not push a partial aggregate below a join by itself, and
aggregating first both shrinks the shuffle and removes hot keys (a customer
with a third of all orders becomes one row per customer).  Sums and counts
are carried instead of means, so the row weights of the original joins are
kept exactly.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.dates import day_diff
from mercato.plans.dimension import dimension_join
from mercato.sources.model import Tables


def order_totals(t: Tables) -> DataFrame:
    """order_id, order_total = SUM(payment_value) per order (exact decimal)."""
    return t.payments.groupBy("order_id").agg(F.sum("payment_value").alias("order_total"))


def english_categories(t: Tables) -> DataFrame:
    """product_id, product_category_name_english (inner: untranslated and
    NULL categories drop out).  Few categories may carry most products, so
    the translation is joined as a dimension (salted)."""
    return (dimension_join(t.products.select("product_id", "product_category_name"),
                           t.translation, ["product_category_name"], ["product_id"])
            .select("product_id", "product_category_name_english"))


def spend_per_customer_id(t: Tables) -> DataFrame:
    """customer_id, spend = SUM(payment_value) over customers x orders x
    payments, computed as order totals -> per customer_id -> customers join.
    The final re-aggregation keeps the join multiplicity exact; it needs no
    shuffle because the join output is already partitioned by customer_id."""
    per_cid = (order_totals(t).join(t.orders.select("order_id", "customer_id"), "order_id")
               .groupBy("customer_id").agg(F.sum("order_total").alias("spend")))
    return (per_cid.join(t.customers.select("customer_id"), "customer_id")
            .groupBy("customer_id").agg(F.sum("spend").alias("spend")))


def spend_by(t: Tables, cols: list[str]) -> DataFrame:
    """``cols`` (customer attributes), total_spending: spend grouped by
    customer attributes, e.g. ['customer_unique_id'] or ['customer_state']."""
    per_cid = (order_totals(t).join(t.orders.select("order_id", "customer_id"), "order_id")
               .groupBy("customer_id").agg(F.sum("order_total").alias("spend")))
    return (per_cid.join(t.customers.select("customer_id", *cols), "customer_id")
            .groupBy(*cols).agg(F.sum("spend").alias("total_spending")))


def delivery_days(orders: DataFrame) -> DataFrame:
    """orders plus ``days`` = calendar days from purchase to delivery."""
    return orders.withColumn("days", day_diff("order_delivered_customer_date",
                                              "order_purchase_timestamp"))


def review_stats(t: Tables) -> DataFrame:
    """Per order present in orders: score_sum, score_n (non-NULL scores) and
    review_rows; one row per matching orders row, as the join would give."""
    per_order = t.reviews.groupBy("order_id").agg(
        F.sum("review_score").alias("score_sum"),
        F.count("review_score").alias("score_n"),
        F.count(F.lit(1)).alias("review_rows"))
    return per_order.join(t.orders.select("order_id"), "order_id")


def with_city_collation(t: Tables, collation: str | None) -> Tables:
    """``t`` with customer cities equal under ``collation`` (e.g.
    'UNICODE_CI_AI': case- and accent-insensitive) replaced by one spelling,
    the smallest in binary order.  None keeps binary comparison.  The city
    list is a dimension (one row per distinct city)."""
    if not collation:
        return t
    key = F.collate("customer_city", collation)
    keyed = t.customers.withColumn("_city_key", key)
    spelling = keyed.groupBy("_city_key").agg(F.min("customer_city").alias("_city"))
    customers = (dimension_join(keyed, spelling, ["_city_key"], ["customer_id"], null_safe=True)
                 .withColumn("customer_city", F.col("_city")).drop("_city_key", "_city"))
    return dataclasses.replace(t, customers=customers)
