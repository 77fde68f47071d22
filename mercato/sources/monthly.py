"""The model stored by purchase month, so that a month is read from its own files.

Orders and the tables that refer to them (items, payments, reviews) are
partitioned by the month of the order's purchase; the others are stored whole.
Writing replaces the months that the given tables hold, each as a whole, and
leaves the others.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.dates import year_month
from mercato.sources import schemas
from mercato.sources.model import FIELD_OF, Tables, read_marketplace

#: The partition column, 'yyyy-MM'; NULL for rows whose order, or its purchase
#: time, is missing.
MONTH = "purchase_month"
#: Fields of ``Tables`` that are stored by month.
DATED = ["orders", "items", "payments", "reviews"]
#: Rows of a month are dealt over as many files, so that no month is one task's.
FILES = 8


def _dated(t: Tables) -> dict[str, DataFrame]:
    """The tables of ``DATED`` with their month."""
    month = year_month("order_purchase_timestamp").alias(MONTH)
    # an order that is stored twice must not double its items
    months = t.orders.groupBy("order_id").agg(F.min(month).alias(MONTH))
    return {field: t.orders.select("*", month) if field == "orders" else
            getattr(t, field).join(months, "order_id", "left").select(*getattr(t, field).columns, MONTH)
            for field in DATED}


def write_by_month(t: Tables, path: str, files: int = FILES) -> None:
    """Store ``t`` under ``path`` for ``read_by_month``; of ``DATED`` only the
    months that ``t`` holds are replaced."""
    dated = _dated(t)
    for name, df in t.by_model_name().items():
        field = FIELD_OF[name]
        target = f"{path.rstrip('/')}/{name}"
        if field not in DATED:
            df.repartition(files).write.mode("overwrite").parquet(target)
        else:
            spread = F.pmod(F.xxhash64(*df.columns), F.lit(files))
            (dated[field].repartition(F.col(MONTH), spread).write.mode("overwrite").partitionBy(MONTH)
             .option("partitionOverwriteMode", "dynamic").parquet(target))


def read_by_month(spark: SparkSession, path: str, months: Iterable[str | None] | None = None,
                  keep_month: bool = False) -> Tables:
    """The tables stored under ``path``; of ``DATED`` only the rows of
    ``months`` (None among them: rows without a month), read from these months'
    files alone.  ``keep_month`` leaves the column ``MONTH`` in place."""
    months = None if months is None else list(months)

    def dated(name: str) -> DataFrame:
        # the month's type is declared: it must not be taken for a date
        schema = T.StructType([*schemas.SCHEMAS[name].fields, T.StructField(MONTH, T.StringType())])
        df = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{name}")
        if months is not None:
            wanted = F.col(MONTH).isin([m for m in months if m is not None])
            df = df.where(wanted | F.col(MONTH).isNull() if None in months else wanted)
        return df if keep_month else df.drop(MONTH)

    return dataclasses.replace(read_marketplace(spark, path), **{
        field: dated(name) for name, field in FIELD_OF.items() if field in DATED})
