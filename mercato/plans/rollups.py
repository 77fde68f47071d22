"""Aggregates that are kept by month and refreshed with the months that change.

A rollup holds sums and counts per (month, key): what reports divide, rank and
add up is additive, so the months' partial results merge exactly, as decimals
and counts.  Distinct counts are not additive; for these a rollup holds the
distinct pairs of a month, whose union over the months is counted (a pair is a
row of two ids; Spark's bitmaps would take 4 KB for each group and 32,768 ids,
of which most groups here have a few).  An order is of one month, so distinct
orders add up.  ``refresh`` computes the given months from a store by month
(``sources.monthly``), reading only their files, and replaces them; a report
then merges a row per month and key instead of all items or payments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.plans import facts
from mercato.plans.skew import skew_join
from mercato.sources.model import Tables
from mercato.sources.monthly import MONTH, read_by_month

ENGLISH = "product_category_name_english"


@dataclass(frozen=True)
class Rollup:
    """``rows``: MONTH, ``keys`` and measures, of tables that have MONTH."""

    keys: list[str]
    measures: list[str]
    rows: Callable[[Tables], DataFrame]

    def sums(self) -> list[Column]:
        return [F.sum(m).alias(m) for m in self.measures]


def _by_category(t: Tables) -> DataFrame:
    per_product = t.items.groupBy(MONTH, "product_id").agg(
        F.sum("price").alias("price_sum"), F.count("price").alias("price_n"), F.count("product_id").alias("units"))
    return per_product.join(facts.english_categories(t), "product_id")


def _by_seller(t: Tables) -> DataFrame:
    # an order is combined first, and is one row for each of its sellers
    per_order = t.items.groupBy(MONTH, "seller_id", "order_id").agg(
        F.sum("price").alias("price_sum"), F.count("product_id").alias("units"), F.sum("freight_value").alias("freight"))
    return per_order.withColumn("orders", F.when(F.col("order_id").isNotNull(), 1).otherwise(0)).drop("order_id")


def _seller_products(t: Tables) -> DataFrame:
    return t.items.select(MONTH, "seller_id", "product_id", F.lit(1).alias("n"))


def _seller_categories(t: Tables) -> DataFrame:
    pairs = t.items.select(MONTH, "seller_id", "product_id").distinct()
    return (pairs.join(t.products.select("product_id", "product_category_name"), "product_id")
            .select(MONTH, "seller_id", "product_category_name", F.lit(1).alias("n")))


def _customer_sellers(t: Tables) -> DataFrame:
    pairs = t.items.select(MONTH, "order_id", "seller_id").distinct()
    return (pairs.join(t.orders.select("order_id", "customer_id"), "order_id")
            .select(MONTH, "customer_id", "seller_id", F.lit(1).alias("n")))


def _category_customers(t: Tables) -> DataFrame:
    pairs = (t.items.select(MONTH, "order_id", "product_id").distinct()
             .join(t.orders.select("order_id", "customer_id"), "order_id")
             .select(MONTH, "product_id", "customer_id").distinct())
    rows = skew_join(pairs, facts.english_categories(t), "product_id", ["customer_id"], weights=t.items)
    return rows.select(MONTH, ENGLISH, "customer_id", F.lit(1).alias("n"))


def _order_totals(t: Tables) -> DataFrame:
    return t.payments.groupBy(MONTH, "order_id").agg(F.sum("payment_value").alias("order_total"))


def _by_state(t: Tables) -> DataFrame:
    per_customer = (_order_totals(t).join(t.orders.select("order_id", "customer_id"), "order_id")
                    .groupBy(MONTH, "customer_id").agg(F.sum("order_total").alias("paid"),
                                                       F.count("order_total").alias("paid_orders")))
    return per_customer.join(t.customers.select("customer_id", "customer_state"), "customer_id")


def _by_month(t: Tables) -> DataFrame:
    paid = _order_totals(t).join(t.orders.select("order_id"), "order_id").groupBy(MONTH).agg(
        F.sum("order_total").alias("paid"), F.count("order_total").alias("paid_orders"))
    orders = t.orders.groupBy(MONTH).agg(F.count("order_id").alias("orders"))
    # payments without an order belong to the total of all payments
    payments = t.payments.groupBy(MONTH).agg(F.sum("payment_value").alias("payments"))
    return paid.unionByName(orders, allowMissingColumns=True).unionByName(payments, allowMissingColumns=True)


ROLLUPS: dict[str, Rollup] = {
    "category": Rollup([ENGLISH], ["price_sum", "price_n", "units"], _by_category),
    "seller": Rollup(["seller_id"], ["price_sum", "units", "freight", "orders"], _by_seller),
    "state": Rollup(["customer_state"], ["paid", "paid_orders"], _by_state),
    "month": Rollup([], ["paid", "paid_orders", "orders", "payments"], _by_month),
    # distinct pairs, and their rows
    "seller_products": Rollup(["seller_id", "product_id"], ["n"], _seller_products),
    "seller_categories": Rollup(["seller_id", "product_category_name"], ["n"], _seller_categories),
    "customer_sellers": Rollup(["customer_id", "seller_id"], ["n"], _customer_sellers),
    "category_customers": Rollup([ENGLISH, "customer_id"], ["n"], _category_customers),
}


def _drop_months(spark: SparkSession, path: str, months: list[str | None]) -> None:
    """Delete the stored rows of ``months``."""
    for month in months:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MONTH}={month or '__HIVE_DEFAULT_PARTITION__'}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def refresh(spark: SparkSession, store: str, path: str, months: Iterable[str | None] | None = None) -> None:
    """Compute ``months`` (None: all) of every rollup from the tables under
    ``store`` and replace them under ``path``.  A month that the store no
    longer has is deleted."""
    t = read_by_month(spark, store, months, keep_month=True)
    for name, rollup in ROLLUPS.items():
        target = f"{path.rstrip('/')}/{name}"
        rows = rollup.rows(t).groupBy(MONTH, *rollup.keys).agg(*rollup.sums())
        if months is None:
            rows.write.mode("overwrite").partitionBy(MONTH).parquet(target)
            continue
        left = {r[0] for r in t.orders.select(MONTH).union(t.items.select(MONTH)).union(t.payments.select(MONTH))
                .distinct().collect()}  # at most the given months
        _drop_months(spark, target, [m for m in months if m not in left])
        (rows.write.mode("overwrite").partitionBy(MONTH)
         .option("partitionOverwriteMode", "dynamic").parquet(target))


def merged(spark: SparkSession, path: str, name: str, by_month: bool = False) -> DataFrame:
    """keys (with ``by_month``: MONTH first) and measures of rollup ``name``,
    added up over the months."""
    rollup = ROLLUPS[name]
    stored = spark.read.parquet(f"{path.rstrip('/')}/{name}")
    return stored.groupBy(*([MONTH] if by_month else []), *rollup.keys).agg(*rollup.sums())
