"""Reviews and satisfaction: Q25-Q27, Q37, Q38, Q49.

Reviews are summed per order first (score sum, scored rows, review rows),
so the item x review fan-out of the source becomes a multiplication by the
item rows: exactly the same weights, without materialising the pairs.
"""

from mercato.reports._common import *  # noqa: F401,F403

ENGLISH = "product_category_name_english"


def _item_reviews(t: Tables, key: str) -> DataFrame:
    """Per (order_id, key): the sums of the order's reviews, times the item
    rows of ``key`` in the order."""
    per_order = t.items.groupBy("order_id", key).agg(F.count(F.lit(1)).alias("_items"))
    joined = per_order.join(facts.review_stats(t), "order_id")
    return joined.select("order_id", key, (F.col("_items") * F.col("score_sum")).alias("score_sum"),
                         (F.col("_items") * F.col("score_n")).alias("score_n"))


def avg_review_by_category(t: Tables) -> DataFrame:
    """Q25: mean review score per English category (item x review weighted)."""
    per_product = _item_reviews(t, "product_id").groupBy("product_id").agg(
        F.sum("score_sum").alias("_sum"), F.sum("score_n").alias("_n"))
    out = (per_product.join(facts.english_categories(t), "product_id").groupBy(ENGLISH)
           .agg(mean(F.sum("_sum"), F.sum("_n")).alias("avg_review_score")))
    return out.orderBy(desc("avg_review_score"), asc(ENGLISH))


def _seller_reviews(t: Tables) -> DataFrame:
    # One row per (order, seller): the count of orders is a distinct one.  An
    # order that orders lists twice (no key is enforced) is merged before the
    # join, by order: merged after it, each task of the join would hold tables
    # of all its (order, seller) besides the join's sorted rows.
    listed = t.orders.groupBy("order_id").agg(F.count(F.lit(1)).alias("_listed"))
    scored = t.reviews.groupBy("order_id").agg(
        F.sum("review_score").alias("score_sum"), F.count("review_score").alias("score_n"))
    items = t.items.groupBy("order_id", "seller_id").agg(F.count(F.lit(1)).alias("_items"))
    weight = F.col("_items") * F.col("_listed")
    per_order = items.join(scored.join(listed, "order_id"), "order_id").select(
        "seller_id", (weight * F.col("score_sum")).alias("score_sum"), (weight * F.col("score_n")).alias("score_n"))
    return per_order.groupBy("seller_id").agg(
        mean(F.sum("score_sum"), F.sum("score_n")).alias("avg_review_score"),
        F.count(F.lit(1)).alias("_orders"))


def avg_review_by_seller(t: Tables) -> DataFrame:
    """Q26: mean review score per seller (item x review weighted)."""
    out = _seller_reviews(t).select("seller_id", "avg_review_score")
    return out.orderBy(desc("avg_review_score"), asc("seller_id"))


def _state_reviews(t: Tables) -> DataFrame:
    per_cid = (facts.review_stats(t).join(t.orders.select("order_id", "customer_id"), "order_id")
               .groupBy("customer_id")
               .agg(F.sum("score_sum").alias("_sum"), F.sum("score_n").alias("_n"),
                    F.sum("review_rows").alias("_rows")))
    return (per_cid.join(t.customers.select("customer_id", "customer_state"), "customer_id")
            .groupBy("customer_state")
            .agg(mean(F.sum("_sum"), F.sum("_n")).alias("avg_review_score"),
                 F.sum("_rows").alias("_rows")))


def avg_review_by_state(t: Tables) -> DataFrame:
    """Q27: mean review score per customer state, over review rows."""
    out = _state_reviews(t).select("customer_state", "avg_review_score")
    return out.orderBy(desc("avg_review_score"), asc("customer_state"))


def avg_review_by_seller_min_orders(t: Tables, min_orders: int = 50) -> DataFrame:
    """Q37: as Q26 for sellers with at least ``min_orders`` distinct reviewed orders."""
    out = (_seller_reviews(t).filter(F.col("_orders") >= min_orders)
           .select("seller_id", "avg_review_score"))
    return out.orderBy(desc("avg_review_score"), asc("seller_id"))


def avg_review_by_state_min_reviews(t: Tables, min_reviews: int = 100) -> DataFrame:
    """Q38: as Q27 for states with at least ``min_reviews`` review rows (the
    source counts joined rows, not distinct orders)."""
    out = (_state_reviews(t).filter(F.col("_rows") >= min_reviews)
           .select("customer_state", "avg_review_score"))
    return out.orderBy(desc("avg_review_score"), asc("customer_state"))


def review_score_by_delivery_status(t: Tables) -> DataFrame:
    """Q49: delivered orders split into 'Delayed' (delivered after the
    estimate) and 'On-Time' (everything else, undated included); review rows
    and mean score rounded to 2."""
    status = F.when(F.col("order_delivered_customer_date")
                    > F.col("order_estimated_delivery_date"), F.lit(DELAYED)) \
        .otherwise(F.lit(ON_TIME))
    delivered = (t.orders.filter(F.col("order_status") == DELIVERED)
                 .select("order_id", status.alias("delivery_status")))
    per_review = t.reviews.groupBy("order_id").agg(
        F.sum("review_score").alias("score_sum"), F.count("review_score").alias("score_n"),
        F.count(F.lit(1)).alias("review_rows"))
    out = (delivered.join(per_review, "order_id").groupBy("delivery_status")
           .agg(F.sum("review_rows").alias("total_orders"),
                rounded_ratio(F.sum("score_sum"), F.sum("score_n")).alias("avg_review_score")))
    return out.orderBy(desc("avg_review_score"), asc("delivery_status"))
