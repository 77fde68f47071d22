"""The ``Tables`` record every report takes, and readers for stored tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.sources import schemas


@dataclass(frozen=True)
class Tables:
    """Lazy DataFrames of the marketplace model (nothing is read until an action)."""

    customers: DataFrame
    orders: DataFrame
    sellers: DataFrame
    products: DataFrame
    items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    translation: DataFrame
    geolocation: DataFrame | None = None

    def by_model_name(self) -> dict[str, DataFrame]:
        """Tables under the names the model declares (see ``schemas.SCHEMAS``)."""
        named = {
            "customers": self.customers,
            "orders": self.orders,
            "sellers": self.sellers,
            "products": self.products,
            "order_items": self.items,
            "order_payments": self.payments,
            "order_reviews": self.reviews,
            "product_category_name_translation": self.translation,
        }
        if self.geolocation is not None:
            named["geolocation"] = self.geolocation
        return named

    def cached(self) -> "Tables":
        """Same tables marked for caching; for running many reports on one snapshot."""
        return Tables(**{f.name: (getattr(self, f.name).cache()
                                  if getattr(self, f.name) is not None else None)
                         for f in fields(self)})


#: Fields of ``Tables`` by the names the model declares.
FIELD_OF = {
    "customers": "customers",
    "orders": "orders",
    "sellers": "sellers",
    "products": "products",
    "order_items": "items",
    "order_payments": "payments",
    "order_reviews": "reviews",
    "product_category_name_translation": "translation",
    "geolocation": "geolocation",
}


# Quoted fields may hold line breaks, and quotes that are doubled; a value that
# does not fit its declared type is an error, not a NULL.
_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "FAILFAST"}

# No report reads it, so a data set without it is complete.
OPTIONAL = {"geolocation"}


def read_marketplace(spark: SparkSession, path: str, fmt: str = "parquet",
                     options: dict | None = None) -> Tables:
    """Read the tables stored as ``{path}/{table_name}`` with declared schemas.

    The schema is given, never inferred, so a scan starts without a sampling
    pass and a wrong type fails loudly.  Parquet/ORC scans get column pruning
    and filter pushdown from Catalyst.  Without a ``geolocation`` folder that
    table is None.

    ``fmt='csv'`` expects a header line and reads quoted line breaks and
    doubled quotes.  Such a file cannot be split: store a large table as many
    files, or convert it once with ``write_marketplace``.
    """
    opts = dict(_CSV) if fmt == "csv" else {}
    opts.update(options or {})
    loaded = {}
    for name, schema in schemas.SCHEMAS.items():
        reader = spark.read.format(fmt).schema(schema).options(**opts)
        try:
            loaded[FIELD_OF[name]] = reader.load(f"{path.rstrip('/')}/{name}")
        except AnalysisException as missing:
            if name not in OPTIONAL or missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return Tables(**loaded)


def from_catalog(spark: SparkSession, database: str) -> Tables:
    """Tables registered in a catalog database under the model names."""
    return Tables(**{FIELD_OF[name]: spark.table(f"{database}.{name}")
                     for name in schemas.SCHEMAS
                     if name not in OPTIONAL or spark.catalog.tableExists(f"{database}.{name}")})


#: Tables that reports join on the order, and the key they are bucketed by.
BUCKETED = {"orders": "order_id", "order_items": "order_id", "order_payments": "order_id",
            "order_reviews": "order_id"}


def save_bucketed(tables: Tables, database: str, buckets: int) -> None:
    """Store the model as tables of catalog database ``database``, orders and
    the tables that refer to them bucketed and sorted by ``order_id``: joins
    and groups on it then need no shuffle (``from_catalog``).

    A bucket is one file, written by one task.  An order that has more rows
    than its share of a bucket is dealt out over several tasks, each of which
    adds a file to its bucket; there are fewer such orders than buckets.
    Choose ``buckets`` as for shuffle partitions of the largest table.
    """
    for name, df in tables.by_model_name().items():
        key = BUCKETED.get(name)
        if key is None:
            df.write.mode("overwrite").saveAsTable(f"{database}.{name}")
            continue
        counts = df.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
        total = counts.agg(F.sum("_n")).scalar()
        hot = F.broadcast(counts.withColumn("_total", total).where(F.col("_n") * buckets > F.col("_total"))
                          .select("_hot", F.ceil(F.col("_n") * buckets / F.col("_total")).alias("_salts")))
        # a partition by the key is a bucket; a hot key's rows go to partitions of small numbers
        salt = F.pmod(F.xxhash64(*df.columns), F.col("_salts")).cast(df.schema[key].dataType)
        rows = (df.join(hot, F.col(key).eqNullSafe(F.col("_hot")), "left")
                .repartition(buckets, F.when(F.col("_salts").isNull(), F.col(key)).otherwise(salt)).select(*df.columns))
        rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(f"{database}.{name}")


def from_frames(spark: SparkSession, rows: dict[str, list]) -> Tables:
    """Tables built from in-memory rows with the declared schemas (hand fixtures)."""
    return Tables(**{FIELD_OF[name]: spark.createDataFrame(rows.get(name, []), schema)
                     for name, schema in schemas.SCHEMAS.items()})


def files_for(input_bytes: int, cores: int, target_bytes: int = 128 << 20) -> int:
    """Files to store a table in: enough for every core to scan, and about
    ``target_bytes`` of input each at scale."""
    return max(1, cores, -(-input_bytes // target_bytes))


def write_marketplace(tables: Tables, path: str, files: int) -> None:
    """Store the model tables as Parquet under ``{path}/{table_name}``.

    Rows are spread round-robin over ``files`` files (see ``files_for``), so a
    later scan runs as parallel tasks and no key, however hot, makes one file
    large.  ``read_marketplace`` reads them back.
    """
    for name, df in tables.by_model_name().items():
        df.repartition(files).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
