"""The nine marketplace tables as declared Spark schemas.

CHAR/VARCHAR/TEXT are plain strings (no padding), DATETIME is
``timestamp_ntz`` (no time zone), money stays exact ``decimal(10,2)``.
"""

from pyspark.sql.types import (DecimalType, IntegerType, StringType, StructField,
                               StructType, TimestampNTZType)

_S, _I, _TS = StringType(), IntegerType(), TimestampNTZType()
_MONEY = DecimalType(10, 2)
_COORD = DecimalType(12, 8)


def _schema(*fields) -> StructType:
    return StructType([StructField(name, dtype, nullable) for name, dtype, nullable in fields])


CUSTOMERS = _schema(
    ("customer_id", _S, False),
    ("customer_unique_id", _S, False),
    ("customer_zip_code_prefix", _I, True),
    ("customer_city", _S, True),
    ("customer_state", _S, True),
)

ORDERS = _schema(
    ("order_id", _S, False),
    ("customer_id", _S, False),
    ("order_status", _S, True),
    ("order_purchase_timestamp", _TS, True),
    ("order_approved_at", _TS, True),
    ("order_delivered_carrier_date", _TS, True),
    ("order_delivered_customer_date", _TS, True),
    ("order_estimated_delivery_date", _TS, True),
)

SELLERS = _schema(
    ("seller_id", _S, False),
    ("seller_zip_code_prefix", _I, True),
    ("seller_city", _S, True),
    ("seller_state", _S, True),
)

PRODUCTS = _schema(
    ("product_id", _S, False),
    ("product_category_name", _S, True),
    ("product_name_lenght", _I, True),
    ("product_description_lenght", _I, True),
    ("product_photos_qty", _I, True),
    ("product_weight_g", _MONEY, True),
    ("product_length_cm", _MONEY, True),
    ("product_height_cm", _MONEY, True),
    ("product_width_cm", _MONEY, True),
)

ORDER_ITEMS = _schema(
    ("order_id", _S, False),
    ("order_item_id", _I, False),
    ("product_id", _S, True),
    ("seller_id", _S, True),
    ("shipping_limit_date", _TS, True),
    ("price", _MONEY, True),
    ("freight_value", _MONEY, True),
)

ORDER_PAYMENTS = _schema(
    ("order_id", _S, False),
    ("payment_sequential", _I, False),
    ("payment_type", _S, True),
    ("payment_installments", _I, True),
    ("payment_value", _MONEY, True),
)

ORDER_REVIEWS = _schema(
    ("review_id", _S, True),
    ("order_id", _S, True),
    ("review_score", _I, True),
    ("review_comment_title", _S, True),
    ("review_comment_message", _S, True),
    ("review_creation_date", _TS, True),
    ("review_answer_timestamp", _TS, True),
)

GEOLOCATION = _schema(
    ("geolocation_zip_code_prefix", _I, True),
    ("geolocation_lat", _COORD, True),
    ("geolocation_lng", _COORD, True),
    ("geolocation_city", _S, True),
    ("geolocation_state", _S, True),
)

CATEGORY_TRANSLATION = _schema(
    ("product_category_name", _S, False),
    ("product_category_name_english", _S, True),
)

# table name -> schema, in the order the model declares them
SCHEMAS = {
    "customers": CUSTOMERS,
    "orders": ORDERS,
    "sellers": SELLERS,
    "products": PRODUCTS,
    "order_items": ORDER_ITEMS,
    "order_payments": ORDER_PAYMENTS,
    "order_reviews": ORDER_REVIEWS,
    "geolocation": GEOLOCATION,
    "product_category_name_translation": CATEGORY_TRANSLATION,
}

# declared keys (primary keys; reviews and geolocation have none)
PRIMARY_KEYS = {
    "customers": ["customer_id"],
    "orders": ["order_id"],
    "sellers": ["seller_id"],
    "products": ["product_id"],
    "order_items": ["order_id", "order_item_id"],
    "order_payments": ["order_id", "payment_sequential"],
    "product_category_name_translation": ["product_category_name"],
}

# declared foreign keys: (child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("orders", "customer_id", "customers", "customer_id"),
    ("products", "product_category_name", "product_category_name_translation",
     "product_category_name"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("order_payments", "order_id", "orders", "order_id"),
    ("order_reviews", "order_id", "orders", "order_id"),
]

# columns declared NOT NULL (primary key columns included)
NOT_NULL = {name: [f.name for f in schema.fields if not f.nullable]
            for name, schema in SCHEMAS.items()}
