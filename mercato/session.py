"""Session construction."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Defaults that matter at any scale: adaptive execution re-plans joins and
# partition counts from runtime sizes and splits skewed join partitions.
_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None,
                  app_name: str = "mercato", extra: dict | None = None) -> SparkSession:
    """A session with adaptive execution.  The number of shuffle partitions is
    the cluster's setting unless ``shuffle_partitions`` is given."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
