"""Ranks, tiles and lags over any number of rows, without a window that one
task must hold.

``Window.orderBy(...)`` with no partition moves every row to one task, and a
window partitioned by a hot key moves that key's rows to one task.  Here rows
get a bucket by cut points over the whole sort key (which ends with a unique
column, so equal values are cut too), windows run within a bucket, and what
must be known of the other buckets (a count, a last row) is one row a bucket.

There are four buckets a shuffle partition, so a bucket's size follows the
cluster's setting, not the input.  The cut points come from a summary of the
sort keys: the rows whose hash is below a share of the hash range, chosen so
that about ``SAMPLE`` a bucket are left of all rows together; every task picks
its own, and one task sorts the keys of these few.  The sample only decides how
even the buckets are.  All is one plan: no job runs before the action, nothing is
checkpointed, and the count, the summary and the rows read the input's last
shuffle from one exchange (``pinned``), so the input is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Least number of buckets, and sampled rows for each bucket.
BUCKETS, SAMPLE = 256, 16
#: Buckets for each shuffle partition.
PER_PARTITION = 4
POS = "_pos"
_B = "_bucket"


def _ascending(keys: list[str]) -> list[Column]:
    return [F.col(k).asc_nulls_first() for k in keys]


def bucket_count(spark: SparkSession) -> int:
    return max(BUCKETS, PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))


def pinned(df: DataFrame) -> DataFrame:
    """``df`` with a filter that needs every column and drops no row.  Branches
    that use different columns of ``df`` then plan the same shuffles below it,
    which Spark runs once and reuses."""
    return df.where(F.bit_count(F.xxhash64(*df.columns)) >= 0)


def with_bucket(df: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """``df`` (``pinned``) plus an int ``_bucket`` below ``buckets`` that does
    not fall along the ascending order of ``keys`` (NULLs first)."""
    buckets = buckets or bucket_count(df.sparkSession)
    df = pinned(df)
    total = df.agg(F.count(F.lit(1))).scalar()
    share = F.xxhash64(*df.columns).cast("double") / 2.0 ** 64 + 0.5
    cuts = (df.where(share * total <= buckets * SAMPLE).agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("_s"))
            .select(F.array_distinct(F.transform(
                F.sequence(F.lit(1), F.lit(buckets - 1)),
                lambda i: F.get("_s", F.floor(i * F.size("_s") / buckets).cast("int")))).alias("_c")))
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(buckets.bit_length()))])

    def below(key: Column) -> Column:
        """How many cuts are not above ``key``, by bisection."""
        return F.aggregate(halves, F.lit(0), lambda at, step: F.when(
            F.get("_f", at + step - 1) <= key, at + step).otherwise(at))

    # the key is bound once, not made anew for each comparison
    bucket = F.transform(F.array(F.struct(*keys)), below)
    # never null, so no filter on it reaches below the last shuffle of one branch
    return df.withColumn("_f", cuts.scalar()).withColumn(_B, F.coalesce(bucket[0], F.lit(0))).drop("_f")


def _positions(df: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(positioned rows, one-row total)."""
    rows = with_bucket(df, keys)
    counts = rows.groupBy(_B).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(_B).alias("_b"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(_B).orderBy(*_ascending(keys)))
    positioned = (rows.withColumn(name, inside.cast("bigint"))
                  .join(F.broadcast(offsets), F.col(_B) == F.col("_b"))  # one row a bucket
                  .withColumn(name, F.col("_offset") + F.col(name))
                  .drop(_B, "_b", "_offset"))
    return positioned, counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"))


def global_positions(df: DataFrame, keys: list[str], name: str = POS) -> DataFrame:
    """``df`` plus a 1-based position ``name`` in the ascending order of
    ``keys`` (NULLs first), which should end with a unique column."""
    return _positions(df, keys, name)[0]


def _int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def ntile_of_position(pos: Column, n: Column, tiles: int) -> Column:
    """SQL NTILE(tiles) of the row at 1-based position ``pos`` among ``n`` rows.

    With q = n div tiles and m = n mod tiles the first m tiles hold q + 1 rows
    and the rest q rows.
    """
    q = _int_div(n, F.lit(tiles))
    m = n - q * tiles
    big = m * (q + 1)
    first = _int_div(pos - 1, q + 1) + 1
    rest = _int_div(pos - 1 - big, q) + m + 1
    return F.when(pos <= big, first).otherwise(rest)


def scalable_ntile(df: DataFrame, keys: list[str], tiles: int, name: str) -> DataFrame:
    """``df`` plus ``name`` = NTILE(tiles) OVER (ORDER BY keys) as bigint."""
    positioned, total = _positions(df, keys, POS)
    with_n = positioned.withColumn("_total", total.scalar())
    return (with_n.withColumn(name, ntile_of_position(F.col(POS), F.col("_total"), tiles)
                              .cast("bigint"))
            .drop(POS, "_total"))


def group_dense_rank(df: DataFrame, group_cols: list[str], value: str, name: str,
                     tie: list[str]) -> DataFrame:
    """``df`` plus ``name`` = DENSE_RANK() OVER (PARTITION BY group ORDER BY
    value DESC NULLS LAST); ``tie`` columns tell rows of one value apart.

    Rows are cut into buckets by (group, value, tie).  A bucket's part of a
    group ranks its values, and adds the distinct values of the group's parts
    above, less one for each value that two neighbouring parts share.
    """
    rows = with_bucket(df, [*group_cols, value, *tie])
    v = F.struct(value)  # a NULL is a value
    parts = rows.groupBy(_B, *group_cols).agg(
        F.count_distinct(v).alias("_n"), F.min(v).alias("_low"), F.max(v).alias("_high"))
    down = Window.partitionBy(*group_cols).orderBy(F.desc(_B))  # one row a bucket, and a group's are less
    shared = F.coalesce(F.lag("_low").over(down) == F.col("_high"), F.lit(False)).cast("int")
    parts = parts.withColumn("_shared", shared)
    above = F.coalesce(F.sum("_n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(
        F.col(_B).alias("_b"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group_cols)],
        (above - F.sum("_shared").over(down.rowsBetween(Window.unboundedPreceding, 0))).alias("_offset"))
    same = F.col(_B) == F.col("_b")
    for i, g in enumerate(group_cols):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = F.dense_rank().over(
        Window.partitionBy(_B, *group_cols).orderBy(F.col(value).desc_nulls_last()))
    return (rows.withColumn(name, inside).join(offsets, same)
            .withColumn(name, (F.col(name) + F.col("_offset")).cast("bigint"))
            .select(*df.columns, name))


def lag_by_position(df: DataFrame, group_cols: list[str], keys: list[str],
                    value: str, name: str) -> DataFrame:
    """``df`` plus ``name`` = LAG(value) OVER (PARTITION BY group ORDER BY
    keys), ascending, NULLs first.

    Rows are cut into buckets by (group, keys).  The row before is that of the
    bucket, or the last row of the bucket before; it counts if its group is
    the same.
    """
    order = [*group_cols, *keys]
    rows = with_bucket(df, order)
    row = F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group_cols)],
                   F.col(value).alias("v"))
    lasts = rows.groupBy(_B).agg(F.max_by(row, F.struct(*order)).alias("_last"))
    lasts = lasts.select(F.col(_B).alias("_b"),
                         F.lag("_last").over(Window.orderBy(_B)).alias("_before"))
    previous = F.lag(row).over(Window.partitionBy(_B).orderBy(*_ascending(order)))
    joined = (rows.withColumn("_previous", previous)
              .join(F.broadcast(lasts), F.col(_B) == F.col("_b"))  # one row a bucket
              .withColumn("_previous", F.coalesce("_previous", "_before")))
    same = F.lit(True)
    for i, g in enumerate(group_cols):
        same = same & F.col(g).eqNullSafe(F.col(f"_previous.g{i}"))
    same = same & F.col("_previous").isNotNull()
    return joined.withColumn(name, F.when(same, F.col("_previous.v"))).select(*df.columns, name)


def running_sum(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``df`` plus ``name`` = SUM(value) OVER (ORDER BY keys), ascending, NULLs
    first, for any number of rows; ``keys`` should end with a unique column.

    A prefix sum in two passes: buckets add up on their own, and each begins at
    the sum of those before it.  As in SQL the sum is NULL until the first
    value that is not."""
    rows = with_bucket(df, keys)
    sums = rows.groupBy(_B).agg(F.sum(value).alias("_sum"))
    before = Window.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(_B).alias("_b"), F.sum("_sum").over(before).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(_B).orderBy(*_ascending(keys))
                               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.when(F.col(name).isNull(), F.col("_before")).otherwise(
        F.col(name) + F.coalesce("_before", F.lit(0)))
    return (rows.withColumn(name, inside)
            .join(F.broadcast(offsets), F.col(_B) == F.col("_b"))  # one row a bucket
            .withColumn(name, total).select(*df.columns, name))
