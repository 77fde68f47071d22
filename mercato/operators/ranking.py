"""Top-k and rank operators.

* ``top_n``: ORDER BY .. LIMIT n; plans as ``TakeOrderedAndProject`` (each
  task keeps its n best rows, the driver merges n x tasks rows).
* ``dense_rank_at_most``: DENSE_RANK() filtered to <= k, computed on the
  distinct values and joined back, so ties meet in no single task.
* ``latest_per_key``: ROW_NUMBER() .. ORDER BY ts DESC = 1 as an aggregate of
  ``max(struct(ts, tie))``: partial aggregation before the shuffle, so a key
  with a third of all rows is reduced map-side.
* ``scalable_ntile`` and ``group_dense_rank`` (re-exported): unbounded
  windows computed in buckets of the sort order (see ``plans.positions``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.plans.dimension import SALTS, dimension_join
from mercato.plans.positions import group_dense_rank, lag_by_position, pinned, running_sum, scalable_ntile

__all__ = ["top_n", "dense_rank_at_most", "latest_per_key", "scalable_ntile",
           "group_dense_rank", "lag_by_position", "running_sum"]


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of ``df`` in ``order`` (end ``order`` with a key for
    a deterministic cut among ties)."""
    return df.orderBy(*order).limit(n)


def dense_rank_at_most(df: DataFrame, partition: list[str], value: str, k: int, name: str,
                       spread_by: list[str]) -> DataFrame:
    """Rows whose DENSE_RANK by descending ``value`` (NULLs last) within
    ``partition`` (global if empty) is <= k, with the rank, for any k.

    The distinct (partition, value) pairs are ranked: first within salted
    shares of a partition, of which each keeps its k best, then among those
    that are left.  The at most k pairs of a partition are joined to the rows,
    salted by a hash of ``spread_by``, the rows' key.  Both read the rows from
    one exchange (``pinned``).
    """
    df = pinned(df)
    values = df.select(*partition, value).distinct()
    best = F.col(value).desc_nulls_last()
    share = F.pmod(F.xxhash64(value), F.lit(SALTS))
    values = (values.withColumn("_share", share)
              .withColumn(name, F.row_number().over(Window.partitionBy(*partition, "_share").orderBy(best)))
              .filter(F.col(name) <= k).drop("_share", name))
    values = (values.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(best)))
              .filter(F.col(name) <= k).withColumn(name, F.col(name).cast("bigint")))
    return dimension_join(df, values, [*partition, value], spread_by, null_safe=True)


def latest_per_key(df: DataFrame, key: str, ts: str, tie: str, cols: list[str]) -> DataFrame:
    """One row per ``key``: the latest ``ts`` (a non-NULL ts beats NULL), the
    largest ``tie`` among equal timestamps."""
    best = F.max(F.struct(F.col(ts).alias("_ts"), F.col(tie).alias("_tie"),
                          *(F.col(c) for c in cols if c not in (key, ts, tie))))
    picked = df.groupBy(key).agg(best.alias("_best"))
    return picked.select(key, *(F.col("_best._ts").alias(c) if c == ts
                                else F.col("_best._tie").alias(c) if c == tie
                                else F.col(f"_best.{c}").alias(c)
                                for c in cols if c != key))
