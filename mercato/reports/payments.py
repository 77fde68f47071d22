"""Payments: Q20, Q21, Q30, Q39."""

from mercato.reports._common import *  # noqa: F401,F403


def payment_method_usage(t: Tables) -> DataFrame:
    """Q20: payment rows per payment type."""
    out = t.payments.groupBy("payment_type").agg(F.count("order_id").alias("frequency"))
    return out.orderBy(desc("frequency"), asc("payment_type"))


def avg_installments_by_method(t: Tables) -> DataFrame:
    """Q21: mean instalments per payment type, over payment rows."""
    out = t.payments.groupBy("payment_type").agg(
        mean(F.sum("payment_installments"), F.count("payment_installments"))
        .alias("avg_installments"))
    return out.orderBy(desc("avg_installments"), asc("payment_type"))


def revenue_by_payment_method(t: Tables) -> DataFrame:
    """Q30: SUM(payment_value) per payment type."""
    out = t.payments.groupBy("payment_type").agg(F.sum("payment_value").alias("_rev"))
    return (out.select("payment_type", as_double("_rev").alias("total_revenue"))
            .orderBy(desc("total_revenue"), asc("payment_type")))


def aov_by_payment_method(t: Tables) -> DataFrame:
    """Q39: each payment row carries its order's total (all types), so an
    order counts once per payment row of a type.  Per (order, type) the row
    count and value sum are combined map-side; the order total is a window
    sum over the few types of one order (never a hot partition)."""
    per_type = (t.payments.filter(F.col("order_id").isNotNull())
                .groupBy("order_id", "payment_type")
                .agg(F.count(F.lit(1)).alias("_rows"), F.sum("payment_value").alias("_value")))
    total = F.sum("_value").over(Window.partitionBy("order_id"))
    weighted = per_type.withColumn("_total", total)
    out = weighted.groupBy("payment_type").agg(
        mean(F.sum(F.col("_rows") * F.col("_total")),
             F.sum(F.when(F.col("_total").isNotNull(), F.col("_rows"))))
        .alias("avg_order_value"))
    return out.orderBy(desc("avg_order_value"), asc("payment_type"))
