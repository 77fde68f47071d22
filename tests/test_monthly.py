"""The store by month, and rollups refreshed month by month."""

import re
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mercato.functions.dates import year_month
from mercato.plans.rollups import ROLLUPS, merged, refresh
from mercato.reports import REPORTS
from mercato.reports.rolled import ROLLED
from mercato.sources.model import Tables, from_frames
from mercato.sources.monthly import DATED, MONTH, read_by_month, write_by_month
from test_fixtures import ROWS


def rows(df):
    return sorted(map(str, df.collect()))


def of_months(t: Tables, keep) -> Tables:
    """Only the orders whose month ``keep`` takes, and what refers to them."""
    import dataclasses
    orders = t.orders.where(keep(year_month("order_purchase_timestamp")))
    ids = orders.select("order_id")
    return dataclasses.replace(t, orders=orders, **{
        f: getattr(t, f).join(ids, "order_id", "left_semi").select(*getattr(t, f).columns)
        for f in DATED if f != "orders"})


def pruned_scans(df, month):
    """The scans of tables stored by month, all of which read ``month`` alone."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if re.search(r"FileScan.*/(orders|order_\w+)\]", line)]
    assert all(re.search(rf"PartitionFilters: \[[^]]*{MONTH}[^]]*{month}", line) for line in scans), scans
    return scans


@pytest.fixture(scope="module")
def tables(spark):
    return from_frames(spark, ROWS)


@pytest.fixture(scope="module")
def months(tables):
    found = tables.orders.select(year_month("order_purchase_timestamp")).distinct().collect()
    return sorted(r[0] for r in found if r[0])


def test_a_month_is_read_from_its_files(spark, tables, months):
    path = tempfile.mkdtemp(prefix="mercato-test-")
    write_by_month(tables, path, files=2)
    whole = read_by_month(spark, path)
    for field in DATED:
        assert rows(getattr(whole, field)) == rows(getattr(tables, field)), field
    one = read_by_month(spark, path, [months[-1]])
    label = year_month("order_purchase_timestamp")
    assert rows(one.orders) == rows(tables.orders.where(label == months[-1]))
    report = REPORTS["q28_monthly_sales"](one)
    assert {(r.year, r.month) for r in report.collect()} <= {tuple(map(int, months[-1].split("-")))}
    assert len(pruned_scans(report, months[-1])) >= 2  # orders and payments
    for field in DATED:
        assert pruned_scans(getattr(one, field), months[-1]), field


def test_rollups_refreshed_by_month_equal_the_reports(spark, tables, months):
    store, path = (tempfile.mkdtemp(prefix="mercato-test-") for _ in range(2))
    assert len(ROLLED) >= 10 and len(months) >= 2
    last = months[-1]
    write_by_month(of_months(tables, lambda m: m.isNull() | (m != last)), store, files=2)
    refresh(spark, store, path)
    before = rows(merged(spark, path, "month"))
    # the last month's orders arrive, with them payments and items without an order
    write_by_month(of_months(tables, lambda m: m == last), store, files=2)
    refresh(spark, store, path, [last])
    assert rows(merged(spark, path, "month")) != before
    known = of_months(tables, lambda m: m.isNull() | m.isNotNull())
    for key, report in ROLLED.items():
        assert report(spark, path).columns == REPORTS[key](known).columns, key
        assert rows(report(spark, path)) == rows(REPORTS[key](known)), key


def test_rows_without_an_order_are_a_month_of_their_own(spark, tables):
    store, path = (tempfile.mkdtemp(prefix="mercato-test-") for _ in range(2))
    write_by_month(tables, store, files=2)
    refresh(spark, store, path)
    refresh(spark, store, path, [None])
    for key, report in ROLLED.items():
        assert rows(report(spark, path)) == rows(REPORTS[key](tables)), key


def test_a_month_is_replaced_and_deleted_as_a_whole(spark, tables, months):
    import shutil
    store, path = (tempfile.mkdtemp(prefix="mercato-test-") for _ in range(2))
    write_by_month(tables, store, files=2)
    refresh(spark, store, path)
    gone, fewer = months[0], months[-1]
    for folder in Path(store).glob(f"*/{MONTH}={gone}"):
        shutil.rmtree(folder)
    cut = of_months(tables, lambda m: m == fewer)
    one_order = cut.orders.orderBy("order_id").limit(1)
    cut = of_months(from_frames(spark, ROWS), lambda m: m == fewer)
    import dataclasses
    keep = one_order.select("order_id")
    cut = dataclasses.replace(cut, orders=cut.orders.join(keep, "order_id", "left_semi").select(*cut.orders.columns))
    write_by_month(cut, store, files=2)
    refresh(spark, store, path, [gone, fewer])
    stored = spark.read.schema(f"{MONTH} string, orders long").parquet(f"{path}/month")
    counts = {r[MONTH]: r.orders for r in stored.collect()}
    assert gone not in counts and counts[fewer] == 1


def test_refreshing_a_month_reads_only_its_files(spark, tables, months):
    store = tempfile.mkdtemp(prefix="mercato-test-")
    write_by_month(tables, store, files=2)
    t = read_by_month(spark, store, [months[0]], keep_month=True)
    for name, rollup in ROLLUPS.items():
        assert pruned_scans(rollup.rows(t), months[0]), name


def test_partials_hold_one_row_a_month_and_key(spark, tables):
    store, path = (tempfile.mkdtemp(prefix="mercato-test-") for _ in range(2))
    write_by_month(tables, store, files=2)
    refresh(spark, store, path)
    for name, rollup in ROLLUPS.items():
        stored = spark.read.parquet(f"{path}/{name}")
        keys = [MONTH, *rollup.keys]
        assert stored.groupBy(*keys).count().where(F.col("count") > 1).isEmpty(), name
