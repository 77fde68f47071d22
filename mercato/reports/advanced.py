"""Rankings and window reports: Q52-Q66.

Windows over a handful of rows (categories, months) run as plain windows.
Windows that would see a whole customer population in one partition are
re-expressed: ranks of distinct values joined back, a per-group aggregate
joined back, or windows in buckets of the sort order (``scalable_ntile``,
``group_dense_rank``, ``lag_by_position``).
"""

from mercato.reports._common import *  # noqa: F401,F403
from mercato.operators.timeseries import period_growth, running_total
from mercato.reports.revenue import category_revenue

ENGLISH = "product_category_name_english"
PURCHASE = "order_purchase_timestamp"
PERSON = "customer_unique_id"


def rank_categories_by_revenue(t: Tables) -> DataFrame:
    """Q52: revenue per English category with its DENSE_RANK (one row per
    category, so the unpartitioned window is small)."""
    rev = category_revenue(t)
    ranked = rev.withColumn("revenue_rank", as_long(F.dense_rank().over(
        Window.orderBy(desc("total_revenue")))))
    return ranked.select(ENGLISH, as_double("total_revenue").alias("total_revenue"),
                         "revenue_rank")


def top_seller_per_state(t: Tables) -> DataFrame:
    """Q53: price sum per (customer state, seller); sellers with DENSE_RANK 1
    in their state (ties kept)."""
    per_cid = (t.items.select("order_id", "seller_id", "price")
               .join(t.orders.select("order_id", "customer_id"), "order_id")
               .groupBy("customer_id", "seller_id").agg(F.sum("price").alias("_sales")))
    sales = (per_cid.join(t.customers.select("customer_id", "customer_state"), "customer_id")
             .groupBy("customer_state", "seller_id").agg(F.sum("_sales").alias("total_sales")))
    top = dense_rank_at_most(sales, ["customer_state"], "total_sales", 1, "drank", ["seller_id"])
    return top.select("customer_state", "seller_id",
                      as_double("total_sales").alias("total_sales"), "drank")


def top_categories_per_state(t: Tables, k: int = 3) -> DataFrame:
    """Q54: price sum per (customer state, English category); DENSE_RANK <= k
    per state (ties kept, so possibly more than k rows)."""
    per_cid = (t.items.select("order_id", "product_id", "price")
               .join(t.orders.select("order_id", "customer_id"), "order_id")
               .groupBy("customer_id", "product_id").agg(F.sum("price").alias("_rev")))
    # a product is one row per state before it meets its category
    per_state = (per_cid.join(t.customers.select("customer_id", "customer_state"), "customer_id")
                 .groupBy("customer_state", "product_id").agg(F.sum("_rev").alias("_rev")))
    rev = (per_state.join(facts.english_categories(t), "product_id")
           .groupBy("customer_state", ENGLISH).agg(F.sum("_rev").alias("product_revenue")))
    top = dense_rank_at_most(rev, ["customer_state"], "product_revenue", k, "drank", [ENGLISH])
    return top.select("customer_state", ENGLISH,
                      as_double("product_revenue").alias("product_revenue"), "drank")


def monthly_revenue(t: Tables) -> DataFrame:
    """yearmonth ('yyyy-MM'), revenue (exact decimal) over orders x payments."""
    return (facts.order_totals(t)
            .join(t.orders.select("order_id", PURCHASE), "order_id")
            .groupBy(year_month(PURCHASE).alias("yearmonth"))
            .agg(F.sum("order_total").alias("revenue")))


def monthly_revenue_growth(t: Tables) -> DataFrame:
    """Q55: revenue per month, the previous present month's revenue and the
    growth percentage (first month NULL)."""
    rev = period_growth(monthly_revenue(t), "yearmonth", "revenue", "prev_month_revenue",
                        "growth_rate", exact=cents)
    return rev.select("yearmonth", as_double("revenue").alias("revenue"),
                      as_double("prev_month_revenue").alias("prev_month_revenue"),
                      "growth_rate")


def monthly_order_growth(t: Tables) -> DataFrame:
    """Q56: orders per month, the previous present month's count and growth."""
    counts = t.orders.groupBy(year_month(PURCHASE).alias("yearmonth")).agg(
        F.count("order_id").alias("month_orders"))
    return period_growth(counts, "yearmonth", "month_orders", "prev_month_orders",
                         "growth_rate")


def latest_order_per_customer(t: Tables) -> DataFrame:
    """Q57: each customer_id's latest order (ties: the largest order_id)."""
    return latest_per_key(t.orders, "customer_id", PURCHASE, "order_id",
                          ["customer_id", "order_id", PURCHASE])


def person_spend(t: Tables) -> DataFrame:
    """customer_unique_id, total_spending (exact decimal)."""
    return facts.spend_by(t, [PERSON])


def top_spenders(t: Tables, k: int = 5) -> DataFrame:
    """Q58: persons whose spend has global DENSE_RANK <= k (ties kept)."""
    top = dense_rank_at_most(person_spend(t), [], "total_spending", k, "_rank", [PERSON])
    return top.select(PERSON, as_double("total_spending").alias("total_spending"))


def top_spenders_per_city(t: Tables, k: int = 3, city_collation: str | None = None) -> DataFrame:
    """Q59: spend per (city, person); DENSE_RANK <= k per city, rank shown.
    Cities compare binary unless ``city_collation`` is given."""
    t = facts.with_city_collation(t, city_collation)
    spend = facts.spend_by(t, ["customer_city", PERSON])
    top = dense_rank_at_most(spend, ["customer_city"], "total_spending", k, "drank", [PERSON])
    return top.select("customer_city", PERSON,
                      as_double("total_spending").alias("total_spending"), "drank")


def order_value_change(t: Tables) -> DataFrame:
    """Q60: each person's order values with the previous order's value (by
    purchase time, ties by order_id) and the difference; first orders and
    orders after a NULL value are dropped, as the source's filter does."""
    values = (facts.order_totals(t)
              .join(t.orders.select("order_id", "customer_id", PURCHASE), "order_id")
              .join(t.customers.select("customer_id", PERSON), "customer_id")
              .groupBy(PERSON, "order_id", PURCHASE)
              .agg(F.sum("order_total").alias("order_value")))
    lagged = lag_by_position(values, [PERSON], [PURCHASE, "order_id"],
                             "order_value", "prev_order_value")
    kept = lagged.filter(F.col("prev_order_value").isNotNull())
    return kept.select(PERSON, "order_id", PURCHASE,
                       as_double("order_value").alias("order_value"),
                       as_double("prev_order_value").alias("prev_order_value"),
                       as_double(F.col("order_value") - F.col("prev_order_value"))
                       .alias("difference"))


def cumulative_monthly_revenue(t: Tables) -> DataFrame:
    """Q61: revenue per month and the running total up to the month."""
    rev = monthly_revenue(t).withColumnRenamed("revenue", "monthly_revenue")
    cum = running_total(rev, "yearmonth", "monthly_revenue", "cumulative_revenue")
    return (cum.select("yearmonth", as_double("monthly_revenue").alias("monthly_revenue"),
                       as_double("cumulative_revenue").alias("cumulative_revenue"))
            .orderBy(asc("yearmonth")))


def customer_revenue_share(t: Tables) -> DataFrame:
    """Q62: spend per person and its percentage of the joined total (a
    one-row aggregate broadcast to all rows, not an unpartitioned window)."""
    spend = person_spend(t)
    total = spend.agg(F.sum("total_spending")).scalar()  # scalar subquery, projected once
    return (spend.withColumn("_total", total)
            .select(PERSON, as_double("total_spending").alias("total_spending"),
                    percent_of(cents("total_spending"), cents("_total"))
                    .alias("revenue_contribution_pct"))
            .orderBy(desc("total_spending"), asc(PERSON)))


def spending_quartiles(t: Tables, tiles: int = 4) -> DataFrame:
    """Q63: NTILE(tiles) of persons by ascending spend (ties by person id),
    from positions in buckets of the order: no single-partition window."""
    spend = person_spend(t)
    tiled = scalable_ntile(spend, ["total_spending", PERSON], tiles,
                           "spending_quartile")
    return (tiled.select(PERSON, as_double("total_spending").alias("total_spending"),
                         "spending_quartile")
            .orderBy(asc("total_spending"), asc(PERSON)))


def spend_vs_state_average(t: Tables) -> DataFrame:
    """Q64: spend per (person, state), the mean spend of the state's persons
    and the rounded difference.  The state mean is a grouped aggregate joined
    back (one row per state), not a window holding a state's persons."""
    spend = facts.spend_by(t, [PERSON, "customer_state"])
    states = spend.groupBy("customer_state").agg(
        F.sum("total_spending").alias("_ssum"), F.count("total_spending").alias("_sn"))
    # one row per state, and a state may hold a third of all persons: joined as
    # a salted dimension, NULL state included; both sides read the spend from
    # the one exchange of its aggregate
    joined = dimension_join(spend, states, ["customer_state"], [PERSON], null_safe=True)
    diff = rounded_ratio(cents("total_spending") * F.col("_sn") - cents("_ssum"),
                         F.col("_sn") * 100)
    return (joined.select(PERSON, "customer_state",
                          as_double("total_spending").alias("total_spending"),
                          mean("_ssum", "_sn").alias("state_avg_spending"),
                          diff.alias("difference"))
            .orderBy(asc("customer_state"), desc("total_spending"), asc(PERSON)))


def monthly_repeat_rate(t: Tables) -> DataFrame:
    """Q65: per month, distinct persons ordering and those whose first order
    was before the month's first day.  Orders are reduced to one row per
    (person, month) first; a person then has at most one row per month, so
    the per-person window and the counts stay small and exact."""
    per_cid = t.orders.groupBy("customer_id", month_start(PURCHASE).alias("_month")).agg(
        F.min(PURCHASE).alias("_first"))
    per_person = (per_cid.join(t.customers.select("customer_id", PERSON), "customer_id")
                  .groupBy(PERSON, "_month").agg(F.min("_first").alias("_first")))
    first = F.min("_first").over(Window.partitionBy(PERSON))
    flagged = per_person.withColumn("_first_ever", first)
    repeat = F.when(F.col("_first_ever") < F.col("_month"), F.col(PERSON))
    monthly = flagged.groupBy(year_month("_month").alias("yearmonth")).agg(
        F.count(PERSON).alias("total_customers"), F.count(repeat).alias("repeat_customers"))
    return (monthly.select("yearmonth", "total_customers", "repeat_customers",
                           percent_of("repeat_customers", "total_customers")
                           .alias("repeat_customer_pct"))
            .orderBy(asc("yearmonth")))


def customer_scorecard(t: Tables, city_collation: str | None = None) -> DataFrame:
    """Q66: per (person, city): distinct orders, spend, mean payment row
    value, first/latest order, and the spend's DENSE_RANK in the city.
    Cities compare binary unless ``city_collation`` is given."""
    t = facts.with_city_collation(t, city_collation)
    per_order = t.payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("_sum"), F.count("payment_value").alias("_n"))
    per_cid = (per_order.join(t.orders.select("order_id", "customer_id", PURCHASE), "order_id")
               .groupBy("customer_id")
               .agg(F.count_distinct("order_id").alias("_orders"),
                    F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"),
                    F.min(PURCHASE).alias("_first"), F.max(PURCHASE).alias("_last")))
    per_person = (per_cid.join(t.customers.select("customer_id", PERSON, "customer_city"),
                               "customer_id")
                  .groupBy(PERSON, "customer_city")
                  .agg(F.sum("_orders").alias("total_orders"),
                       F.sum("_sum").alias("_spend"), F.sum("_n").alias("_n"),
                       F.min("_first").alias("first_order_date"),
                       F.max("_last").alias("latest_order_date")))
    ranked = group_dense_rank(per_person, ["customer_city"], "_spend", "spending_rank", [PERSON])
    return (ranked.select(PERSON, "customer_city", as_long("total_orders").alias("total_orders"),
                          as_double("_spend").alias("total_spending"),
                          rounded_ratio(cents("_spend"), F.col("_n") * 100)
                          .alias("avg_order_value"),
                          "first_order_date", "latest_order_date", "spending_rank")
            .orderBy(asc("customer_city"), asc("spending_rank"), asc(PERSON)))
