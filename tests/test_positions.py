"""Bucketed window replacements against Spark's own windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mercato.operators.ranking import dense_rank_at_most
from mercato.plans.dimension import dimension_join
from mercato.plans.positions import (global_positions, group_dense_rank, lag_by_position,
                                     ntile_of_position, running_sum, scalable_ntile, with_bucket)
from mercato.plans.skew import skew_join


def _values(n, seed, hot=None):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = hot if hot is not None and rnd.random() < 0.5 else f"g{rnd.randint(0, 4)}"
        v = rnd.choice([None, *range(8)]) if rnd.random() < 0.9 else None
        rows.append((i, g if rnd.random() < 0.97 else None, v))
    return rows


def _frame(spark, n, seed, hot=None):
    return spark.createDataFrame(_values(n, seed, hot), "id long, g string, v int").repartition(4)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 10, 22, 257, 1500])
def test_scalable_ntile_matches_ntile(spark, n):
    df = _frame(spark, n, n)
    ours = scalable_ntile(df, ["v", "id"], 4, "tile").select("id", "tile")
    order = [F.col("v").asc_nulls_first(), F.col("id").asc()]
    ref = df.select("id", F.ntile(4).over(Window.orderBy(*order)).cast("bigint").alias("tile"))
    assert sorted(ours.collect()) == sorted(ref.collect())


def test_ntile_formula_small_n(spark):
    # tile sizes: n = 10, 4 tiles -> 3, 3, 2, 2
    rows = spark.range(1, 11).select(
        ntile_of_position(F.col("id"), F.lit(10), 4).alias("t")).collect()
    assert [r.t for r in rows] == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4]


def test_global_positions_are_a_permutation(spark):
    rows = global_positions(_frame(spark, 300, 7), ["v", "id"]).orderBy("_pos").collect()
    assert [r._pos for r in rows] == list(range(1, 301))
    keys = [((r.v is not None), r.v or 0, r.id) for r in rows]
    assert keys == sorted(keys)


def test_equal_values_are_cut_into_buckets(spark):
    df = spark.range(20_000).select(F.lit(7).alias("v"), "id")
    sizes = [r["count"] for r in with_bucket(df, ["v", "id"]).groupBy("_bucket").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 600


@pytest.mark.parametrize("hot", [None, "hot"])
@pytest.mark.parametrize("n", [0, 40, 3000])
def test_group_dense_rank_matches_window(spark, hot, n):
    df = _frame(spark, n, 11, hot)
    ours = group_dense_rank(df, ["g"], "v", "r", ["id"]).select("id", "r")
    w = Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last())
    ref = df.select("id", F.dense_rank().over(w).cast("bigint").alias("r"))
    assert sorted(ours.collect()) == sorted(ref.collect())


@pytest.mark.parametrize("hot", [None, "hot"])
@pytest.mark.parametrize("n", [0, 40, 3000])
def test_lag_by_position_matches_window(spark, hot, n):
    df = _frame(spark, n, 13, hot)
    ours = lag_by_position(df, ["g"], ["v", "id"], "id", "prev").select("id", "prev")
    order = [F.col("v").asc_nulls_first(), F.col("id").asc()]
    ref = df.select("id", F.lag("id").over(Window.partitionBy("g").orderBy(*order)).alias("prev"))
    assert sorted(ours.collect(), key=str) == sorted(ref.collect(), key=str)


@pytest.mark.parametrize("partition", [[], ["g"]])
@pytest.mark.parametrize("k", [1, 3, 2000])
def test_rank_filter_matches_window(spark, partition, k):
    df = _frame(spark, 800, 19, "hot")
    ours = dense_rank_at_most(df, partition, "v", k, "r", ["id"]).select("id", "r")
    w = Window.partitionBy(*partition).orderBy(F.col("v").desc_nulls_last())
    ref = df.select("id", F.dense_rank().over(w).cast("bigint").alias("r")).where(f"r <= {k}")
    assert sorted(ours.collect()) == sorted(ref.collect())


def test_rank_filter_spreads_ties(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(20_000).select("id", F.lit(1.5).alias("v"))
        top = dense_rank_at_most(df, [], "v", 5, "r", ["id"])
        sizes = [r["count"] for r in top.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and len(sizes) > 3 and max(sizes) < 10_000
        many = dense_rank_at_most(spark.range(50_000).withColumnRenamed("id", "v").withColumn("id", F.col("v")),
                                  [], "v", 2000, "r", ["id"])
        assert many.count() == 2000
        plan = many._jdf.queryExecution().executedPlan().toString()
        assert "_share" in plan and plan.count("<= 2000") >= 2  # a limit before the single task
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_dimension_join_is_an_inner_join(spark, threshold):
    big = spark.createDataFrame(_values(500, 17, "hot"), "id long, g string, v int")
    small = spark.createDataFrame([("hot", 1), ("g1", 2), (None, 3)], "g string, w int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = dimension_join(big, small, ["g"], ["id"], salts=7, null_safe=True)
        ref = big.join(small, big["g"].eqNullSafe(small["g"])).select(big["id"], big["g"],
                                                                      big["v"], small["w"])
        assert sorted(got.select("id", "g", "v", "w").collect(), key=str) == sorted(ref.collect(), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_buckets_follow_the_shuffle_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        df = spark.range(30_000).select(F.lit("a").alias("g"), F.lit(7).alias("v"), "id")
        rows = with_bucket(df, ["g", "v", "id"])
        sizes = {r._bucket: r["count"] for r in rows.groupBy("_bucket").count().collect()}
        assert len(sizes) > 700 and max(sizes) < 800 and max(sizes.values()) < 150
        # along the order of the keys
        ends = rows.groupBy("_bucket").agg(F.min("id").alias("a"), F.max("id").alias("z")).orderBy("_bucket").collect()
        assert all(x.z < y.a for x, y in zip(ends, ends[1:]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("make", [
    lambda df: scalable_ntile(df, ["total", "g"], 4, "tile"),
    lambda df: group_dense_rank(df, ["g"], "total", "r", ["h"]),
    lambda df: lag_by_position(df, ["g"], ["h"], "total", "prev"),
])
def test_the_input_of_bucketed_windows_is_computed_once(spark, make):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        path = "/root/testdata/sf0.001/lineitem.parquet"
        df = spark.read.parquet(path).groupBy(F.col("l_suppkey").alias("g"), F.col("l_linenumber").alias("h")).agg(
            F.sum("l_quantity").alias("total"), F.max("l_tax").alias("other"))
        plan = make(df)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("null_rows", [0, 50])
def test_skew_join_is_an_inner_join(spark, null_rows):
    big = spark.createDataFrame(_values(900, 23, "hot"), "id long, g string, v int").repartition(3)
    small = spark.createDataFrame([("hot", 1), ("hot", 5), ("g1", 2), ("g2", 4), (None, 3), ("gone", 9)], "g string, w int")
    got = skew_join(big, small, "g", ["id"])
    ref = big.join(small, "g")
    columns = ["id", "g", "v", "w"]
    assert got.columns == ["id", "g", "v", "w"]
    assert sorted(got.select(columns).collect(), key=str) == sorted(ref.select(columns).collect(), key=str)
    assert skew_join(big.limit(0), small, "g", ["id"]).count() == 0


def test_skew_join_deals_out_a_hot_key_and_copies_no_other(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id"))
        big = spark.range(24_000).select("id", key.alias("k"))
        small = big.select("k").distinct().withColumn("w", F.col("k") * 2)
        joined = skew_join(big, small, "k", ["id"])
        assert joined.count() == 24_000 and joined.where("w <> 2 * k").isEmpty()
        hot = [r["count"] for r in joined.where("k = -1").groupBy(F.spark_partition_id()).count().collect()]
        assert len(hot) >= 2 and max(hot) <= 24_000 / 8 * 2
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 3 * 24_000 / 8
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Generate explode(sequence" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("n", [0, 1, 700])
def test_running_sum_matches_window(spark, n):
    df = _frame(spark, n, 29, "hot").withColumn("d", F.col("v").cast("decimal(10,2)"))
    for value in ("v", "d"):
        ours = running_sum(df, ["g", "v", "id"], value, "total").select("id", "total")
        order = [F.col(c).asc_nulls_first() for c in ("g", "v", "id")]
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ref = df.select("id", F.sum(value).over(w).alias("total"))
        assert sorted(ours.collect()) == sorted(ref.collect())


def test_running_total_over_all_orders(spark):
    """Of the revenue, order by order, without a window that one task holds."""
    from mercato.plans.facts import order_totals
    from mercato.sources.binding import bind_star
    t = bind_star(spark, "/root/testdata/sf0.001")
    orders = order_totals(t).join(t.orders.select("order_id", "order_purchase_timestamp"), "order_id")
    keys = ["order_purchase_timestamp", "order_id"]
    ours = running_sum(orders, keys, "order_total", "so_far")
    ref = orders.withColumn("so_far", F.sum("order_total").over(Window.orderBy(*keys)))
    assert sorted(ours.select("order_id", "so_far").collect()) == sorted(ref.select("order_id", "so_far").collect())
    plan = ours._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_bucket" in line for line in windows)
