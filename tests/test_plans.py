"""Physical-plan properties that matter at scale, with broadcasts and without."""

import re
import tempfile

import pytest

import __spark_entry__ as entry
from mercato.reports import REPORTS
from mercato.sources.model import from_frames, read_marketplace, write_marketplace
from test_fixtures import ROWS

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {k: v for k, v in entry.queries().items() if k in REPORTS}


@pytest.fixture(params=["broadcasts", "no broadcasts"])
def spark_(spark, request):
    if request.param == "no broadcasts":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture()
def shuffled(spark):
    """No broadcasts, and the plan as planned, without adaptive execution."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def plan_of(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_in_any_plan(spark, name):
    plan = plan_of(spark, name)
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                 "MapInPandas", "MapInArrow", "PythonUDF"):
        assert node not in plan, (name, node)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loop_or_cross_join(spark_, name):
    plan = plan_of(spark_, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_building_a_query_runs_no_job_and_writes_nothing(spark):
    # a report that starts work while it is built would be a checkpoint or a count
    tracker = spark.sparkContext.statusTracker()
    for name in sorted(QUERIES):
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        QUERIES[name](spark, SF_DIR)
        assert list(tracker.getJobIdsForGroup(f"build-{name}")) == [], name
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rank_filters_limit_before_the_shuffle(spark_):
    for name in ("q53_top_seller_per_state", "q54_top_categories_per_state",
                 "q58_top_spenders", "q59_top_spenders_per_city"):
        plan = plan_of(spark_, name)
        assert "WindowGroupLimit" in plan and "Partial" in plan, name
        assert "_share" in plan, name  # a group's values are ranked in shares first


def test_person_level_windows_are_bounded(spark_):
    # windows run within a bucket, or over one row a bucket (a count, a sum of
    # parts, a last row); no window sorts all persons or all of one city
    for name in ("q60_order_value_change", "q62_customer_revenue_share",
                 "q63_spending_quartiles", "q64_spend_vs_state_average",
                 "q66_customer_scorecard"):
        windows = [line for line in plan_of(spark_, name).splitlines() if "Window [" in line]
        assert all(re.search(r"_bucket|_shared|sum\(_n", line) for line in windows), (name, windows)


def test_scans_are_pruned_and_filters_pushed(spark):
    plan = plan_of(spark, "q09_top_sellers_by_revenue")
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double>" in plan
    folder = tempfile.mkdtemp(prefix="mercato-test-")
    write_marketplace(from_frames(spark, ROWS), folder, files=1)
    stored = REPORTS["q16_avg_delivery_days"](read_marketplace(spark, folder))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(order_status), EqualTo(order_status,delivered)]" in plan


def below(plan: str, pattern: str) -> list[str]:
    """The operator right below each exchange whose line matches ``pattern``."""
    lines = plan.splitlines()
    found = []
    for i, line in enumerate(lines):
        if re.search(r"Exchange hashpartitioning\((%s)" % pattern, line):
            found.append(lines[i + 1])
    return found


@pytest.mark.parametrize("name,key", [
    ("q32_avg_category_revenue_per_order", "product_id"),
    ("q35_top_sellers_by_category_breadth", "product_id"),
    ("q36_top_categories_by_distinct_customers", "product_id"),
    ("q54_top_categories_per_state", "product_id"),
    ("q25_avg_review_by_category", "product_id"),
    ("q37_avg_review_by_seller_min_orders", "seller_id"),
])
def test_rows_are_reduced_before_they_meet_a_hot_key(shuffled, name, key):
    children = below(plan_of(shuffled, name), key)
    # the products' own side has one row a key
    facts = [c for c in children if "p_partkey" not in c and "product_category_name" not in c]
    assert facts and all("Aggregate" in c for c in facts), (name, children)


@pytest.mark.parametrize("name", ["q26_avg_review_by_seller", "q37_avg_review_by_seller_min_orders"])
def test_the_join_of_seller_reviews_keeps_no_table_by_order(shuffled, name):
    above = re.split(r"SortMergeJoin|HashJoin", plan_of(shuffled, name))[0]
    assert "seller_id" in above and not re.search(r"Aggregate\(keys=\[[^\]]*order_id", above), above


def test_category_orders_are_summed_once(shuffled):
    plan = plan_of(shuffled, "q32_avg_category_revenue_per_order")
    assert not re.search(r"Aggregate\(keys=\[product_id#\w+, order_id#", plan), plan
    # after the items are dealt out, not by the tasks that read them
    dealt = re.search(r"Exchange hashpartitioning\(product_category_name#\w+, order_id#.*REPARTITION_BY_NUM", plan)
    assert dealt and not re.search(r"Aggregate\(keys=\[[^\]]*order_id", plan[dealt.end():]), plan


def test_latest_order_is_combined_before_the_shuffle(shuffled):
    plan = plan_of(shuffled, "q57_latest_order_per_customer")
    assert "partial_max" in plan and "Window" not in plan
    assert all("Aggregate" in c or "Sort" in c for c in below(plan, "customer_id"))
    assert plan.index("partial_max") > plan.index("Exchange hashpartitioning(customer_id")


def test_spend_is_computed_once_for_the_state_average(shuffled):
    df = QUERIES["q64_spend_vs_state_average"](shuffled, SF_DIR)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
    assert plan.count("Scan parquet") <= 5, plan  # payments, orders, customers, nation, region


def test_integrity_report_scans_items_at_most_twice(shuffled):
    df = QUERIES["integrity_report"](shuffled, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # order_items and order_payments are bound to lineitem, each read twice
    assert len(re.findall(r"FileScan parquet .*lineitem", plan)) <= 4


@pytest.mark.parametrize("name", ["q53_top_seller_per_state", "q54_top_categories_per_state", "q58_top_spenders",
                                  "q59_top_spenders_per_city", "q60_order_value_change",
                                  "q63_spending_quartiles", "q66_customer_scorecard"])
def test_ranks_and_bucketed_windows_read_their_input_once(shuffled, name):
    plan = plan_of(shuffled, name)
    assert len(re.findall(r"FileScan parquet .*lineitem", plan)) == 1, name
    assert "ReusedExchange" in plan
