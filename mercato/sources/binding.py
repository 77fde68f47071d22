"""Binding of the star-schema test tables to the marketplace model.

The test data is a star schema (region, nation, customer, supplier, part,
orders, lineitem).  ``bind_star`` derives the nine model tables from it with
plain projections and joins, so every report reads the given tables and its
work grows with them.  Ids stay ``bigint`` (reports never depend on the id
type).

Fixed binding rules (the oracle SQL repeats them; keep the two in step):
  customers  customer_id = c_custkey, customer_unique_id = c_custkey div 2
             (two accounts per person), city = nation name, state = region name
  sellers    seller_id = s_suppkey, city = nation name, state = region name
  products   product_id = p_partkey, category = p_brand, NULL when p_size = 50
  translation one row per brand except 'Brand#25' (an untranslated category);
             english name = brand with '#' replaced by a space
  orders     status F/O/P = delivered/shipped/canceled;
             purchase = o_orderdate + (o_orderkey % 24) hours;
             delivered = NULL for canceled orders and when o_orderkey % 97 = 0,
             else o_orderdate + (1 + o_orderkey % 45) days + (o_orderkey * 5 % 24) hours;
             estimated = o_orderdate + 30 days
  order_items one per lineitem: price = l_extendedprice, freight = l_quantity
  order_payments one per lineitem: type = l_returnflag,
             installments = 1 + l_linenumber, value = price + freight
  order_reviews score = first digit of o_orderpriority; no review when
             o_orderkey % 10 = 9, a second review (score 6 - first) when
             o_orderkey % 10 = 0; review_id = 2 * order_id (+ 1 for the second)
The modulo terms synthesise model cases (undated deliveries, unreviewed and
twice-reviewed orders); they derive data, they do not subset the workload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mercato.plans.dimension import dimension_join
from mercato.sources.model import Tables

# Declared schemas of the star tables that are read (given, never inferred:
# inference would cost a Spark job per table on every bind).
STAR_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
              "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}

# Fixed values of the binding (the oracle SQL repeats them).
UNTRANSLATED_BRAND = "Brand#25"
NULL_CATEGORY_SIZE = 50

# Projections as SQL expressions: one call per table instead of one per
# column expression, which keeps binding cheap on the driver.
_PRICE = "CAST(l_extendedprice AS DECIMAL(10,2))"
_FREIGHT = "CAST(l_quantity AS DECIMAL(10,2))"
_SCORE = "CAST(substring(o_orderpriority, 1, 1) AS INT)"

_CUSTOMERS = [
    "c_custkey AS customer_id",
    "c_custkey div 2 AS customer_unique_id",
    "CAST(NULL AS INT) AS customer_zip_code_prefix",
    "city AS customer_city",
    "state AS customer_state",
]
_SELLERS = [
    "s_suppkey AS seller_id",
    "CAST(NULL AS INT) AS seller_zip_code_prefix",
    "city AS seller_city",
    "state AS seller_state",
]
_PRODUCTS = [
    "p_partkey AS product_id",
    f"CASE WHEN p_size <> {NULL_CATEGORY_SIZE} THEN p_brand END AS product_category_name",
    "CAST(NULL AS INT) AS product_name_lenght",
    "CAST(NULL AS INT) AS product_description_lenght",
    "CAST(NULL AS INT) AS product_photos_qty",
    "CAST(NULL AS DECIMAL(10,2)) AS product_weight_g",
    "CAST(NULL AS DECIMAL(10,2)) AS product_length_cm",
    "CAST(NULL AS DECIMAL(10,2)) AS product_height_cm",
    "CAST(NULL AS DECIMAL(10,2)) AS product_width_cm",
]
_ORDERS = [
    "o_orderkey AS order_id",
    "o_custkey AS customer_id",
    "CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' "
    "WHEN 'P' THEN 'canceled' END AS order_status",
    "o_orderdate + make_dt_interval(0, CAST(o_orderkey % 24 AS INT)) "
    "AS order_purchase_timestamp",
    "CAST(NULL AS TIMESTAMP_NTZ) AS order_approved_at",
    "CAST(NULL AS TIMESTAMP_NTZ) AS order_delivered_carrier_date",
    "CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 97 <> 0 THEN o_orderdate + "
    "make_dt_interval(CAST(1 + o_orderkey % 45 AS INT), CAST(o_orderkey * 5 % 24 AS INT)) "
    "END AS order_delivered_customer_date",
    "o_orderdate + make_dt_interval(30) AS order_estimated_delivery_date",
]
_REVIEW_TAIL = [
    "CAST(NULL AS STRING) AS review_comment_title",
    "CAST(NULL AS STRING) AS review_comment_message",
    "CAST(NULL AS TIMESTAMP_NTZ) AS review_creation_date",
    "CAST(NULL AS TIMESTAMP_NTZ) AS review_answer_timestamp",
]
_ITEMS = [
    "l_orderkey AS order_id",
    "l_linenumber AS order_item_id",
    "l_partkey AS product_id",
    "l_suppkey AS seller_id",
    "l_shipdate AS shipping_limit_date",
    f"{_PRICE} AS price",
    f"{_FREIGHT} AS freight_value",
]
_PAYMENTS = [
    "l_orderkey AS order_id",
    "l_linenumber AS payment_sequential",
    "l_returnflag AS payment_type",
    "l_linenumber + 1 AS payment_installments",
    f"CAST({_PRICE} + {_FREIGHT} AS DECIMAL(10,2)) AS payment_value",
]


def bind_star(spark: SparkSession, sf_dir: str) -> Tables:
    def read(name: str) -> DataFrame:
        return spark.read.schema(STAR_SCHEMAS[name]).parquet(
            f"{sf_dir.rstrip('/')}/{name}.parquet")

    # nation key -> (city, state): a dimension, whose keys may be hot
    nation, region = read("nation"), read("region")
    places = (nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
              .selectExpr("n_nationkey AS nationkey", "n_name AS city", "r_name AS state"))

    def placed(name: str, prefix: str, key: str) -> DataFrame:
        return dimension_join(read(name).withColumnRenamed(f"{prefix}_nationkey", "nationkey"),
                              places, ["nationkey"], [key])

    customers = placed("customer", "c", "c_custkey").selectExpr(*_CUSTOMERS)
    sellers = placed("supplier", "s", "s_suppkey").selectExpr(*_SELLERS)

    part = read("part")
    products = part.selectExpr(*_PRODUCTS)
    translation = (part.where(f"p_brand <> '{UNTRANSLATED_BRAND}'").select("p_brand").distinct()
                   .selectExpr("p_brand AS product_category_name",
                               "replace(p_brand, '#', ' ') AS product_category_name_english"))

    o = read("orders")
    orders = o.selectExpr(*_ORDERS)
    first_review = o.where("o_orderkey % 10 <> 9").selectExpr(
        "o_orderkey * 2 AS review_id", "o_orderkey AS order_id", f"{_SCORE} AS review_score")
    second_review = o.where("o_orderkey % 10 = 0").selectExpr(
        "o_orderkey * 2 + 1 AS review_id", "o_orderkey AS order_id",
        f"6 - {_SCORE} AS review_score")
    reviews = first_review.unionByName(second_review).selectExpr(
        "review_id", "order_id", "review_score", *_REVIEW_TAIL)

    li = read("lineitem")
    items = li.selectExpr(*_ITEMS)
    payments = li.selectExpr(*_PAYMENTS)

    return Tables(customers=customers, orders=orders, sellers=sellers, products=products,
                  items=items, payments=payments, reviews=reviews, translation=translation)
