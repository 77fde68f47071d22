"""Readers and the stored model: declared schemas round-trip."""

import dataclasses
import tempfile
from datetime import datetime as T
from decimal import Decimal as D
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mercato.reports import REPORTS
from mercato.session import build_session
from mercato.sources import schemas
from mercato.sources.binding import bind_star
from mercato.sources.model import (files_for, from_catalog, from_frames, read_marketplace, save_bucketed,
                                   write_marketplace)
from test_fixtures import ROWS

SAMPLE = ["q07_top_categories_by_revenue", "q24_aov_per_seller_as_written",
          "q49_review_score_by_delivery_status", "q65_monthly_repeat_rate"]
GEO = {"geolocation": [(1046, D("-23.54562100"), D("-46.63929300"), "são paulo", "SP"),
                       (1046, D("-23.54608100"), D("-46.64482000"), "sao paulo", "SP")]}


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="mercato-test-")


@pytest.mark.parametrize("fmt", ["parquet", "csv", "orc", "json"])
def test_round_trip_with_every_table(spark, folder, fmt):
    t = from_frames(spark, ROWS | GEO)
    for name, df in t.by_model_name().items():
        df.write.format(fmt).option("header", "true").save(f"{folder}/{name}")
    back = read_marketplace(spark, folder, fmt=fmt)
    for name, df in back.by_model_name().items():
        assert [f.dataType for f in df.schema] == [f.dataType for f in schemas.SCHEMAS[name]]
        assert sorted(map(str, df.collect())) == sorted(map(str, t.by_model_name()[name].collect())), name
    for name in SAMPLE:
        assert _rows(REPORTS[name](back)) == _rows(REPORTS[name](t)), name


def test_geolocation_has_two_rows_for_a_prefix(spark):
    geo = from_frames(spark, ROWS | GEO).geolocation
    assert geo.groupBy("geolocation_zip_code_prefix").count().collect()[0]["count"] == 2
    assert geo.schema == schemas.SCHEMAS["geolocation"]


def test_written_tables_load_again_without_geolocation(spark, folder):
    bound = bind_star(spark, "/root/testdata/sf0.001")
    write_marketplace(bound, folder, files=2)
    assert not (Path(folder) / "geolocation").exists()
    # ids of the bound model are numbers
    back = read_marketplace_as(spark, folder, bound)
    assert back.geolocation is None
    for name in SAMPLE:
        assert _rows(REPORTS[name](back)) == _rows(REPORTS[name](bound)), name


def read_marketplace_as(spark, folder, like):
    """``read_marketplace`` with the id types of ``like``."""
    declared = dict(schemas.SCHEMAS)
    try:
        schemas.SCHEMAS.update({n: df.schema for n, df in like.by_model_name().items()})
        return read_marketplace(spark, folder)
    finally:
        schemas.SCHEMAS.clear()
        schemas.SCHEMAS.update(declared)


def test_only_geolocation_may_be_missing(spark, folder):
    t = from_frames(spark, ROWS)
    for name, df in t.by_model_name().items():
        if name != "sellers":
            df.write.parquet(f"{folder}/{name}")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_marketplace(spark, folder)


def test_catalog_tables(spark, folder):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS mercato_test LOCATION '{folder}'")
    t = from_frames(spark, ROWS)
    try:
        for name, df in t.by_model_name().items():
            if name != "geolocation":
                df.write.saveAsTable(f"mercato_test.{name}")
        back = from_catalog(spark, "mercato_test")
        assert back.geolocation is None
        for name in SAMPLE:
            assert _rows(REPORTS[name](back)) == _rows(REPORTS[name](t)), name
    finally:
        spark.sql("DROP DATABASE mercato_test CASCADE")


REVIEWS = '''review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp
r1,o1,5,title,"two
lines, and a comma",2020-01-02 00:00:00,2020-01-03 10:00:00
r2,o1,3,,"it was ""very good"", they say",2020-02-02 00:00:00,2020-02-03 10:00:00
r3,o3,{score},"a ""title""","line
""quoted""
line",2020-03-02 00:00:00,2020-03-03 10:00:00
'''


def _csv(spark, folder, score):
    for name, df in from_frames(spark, ROWS).by_model_name().items():
        if name != "order_reviews":
            df.write.option("header", "true").csv(f"{folder}/{name}")
    (Path(folder) / "order_reviews").mkdir()
    (Path(folder) / "order_reviews" / "part.csv").write_text(REVIEWS.format(score=score))
    return read_marketplace(spark, folder, fmt="csv")


def test_csv_with_line_breaks_and_doubled_quotes(spark, folder):
    rows = sorted(_csv(spark, folder, 1).reviews.collect())
    assert [tuple(r)[:5] for r in rows] == [
        ("r1", "o1", 5, "title", "two\nlines, and a comma"),
        ("r2", "o1", 3, None, 'it was "very good", they say'),
        ("r3", "o3", 1, 'a "title"', 'line\n"quoted"\nline')]
    assert rows[1].review_creation_date == T(2020, 2, 2)


def test_csv_with_a_bad_number_fails(spark, folder):
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        _csv(spark, folder, "abc").reviews.collect()


def test_session_leaves_the_partitions_to_the_cluster(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert build_session("local[4]").conf.get("spark.sql.shuffle.partitions") == before


def test_files_grow_with_the_input():
    assert files_for(0, 4) == 4
    assert files_for(10 << 30, 4) == 80
    assert files_for(100 << 40, 8) == 819_200


def test_bucketed_tables_join_on_the_order_without_a_shuffle(spark, folder):
    bound = bind_star(spark, "/root/testdata/sf0.001")
    # an order with a third of the rows, and rows of no order
    hot = bound.items.withColumn("order_item_id", F.col("order_item_id") + 100).withColumn("order_id", F.lit(1).cast("long"))
    lost = bound.items.limit(40).withColumn("order_id", F.lit(None).cast("long"))
    t = dataclasses.replace(bound, items=bound.items.union(hot).union(lost))
    spark.sql(f"CREATE DATABASE mercato_buckets LOCATION '{folder}'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        save_bucketed(t, "mercato_buckets", buckets=8)
        back = from_catalog(spark, "mercato_buckets")
        for name in ("q24_aov_per_seller_as_written", "q39_aov_by_payment_method",
                     "q44_avg_items_per_order_by_customer", "q26_avg_review_by_seller"):
            df = REPORTS[name](back)
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and "hashpartitioning(order_id" not in plan, name
            assert _rows(df) == _rows(REPORTS[name](t)), name
        assert back.items.count() == t.items.count()
        files = back.items.inputFiles()
        assert len(files) > 8  # the hot order's bucket has several
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sql("DROP DATABASE mercato_buckets CASCADE")
