"""Relations that must hold between reports, and invariance to partitioning."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from mercato.reports import REPORTS
from mercato.sources.binding import bind_star

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return bind_star(spark, SF_DIR)


def total(df, col):
    return df.agg(F.sum(col)).collect()[0][0]


def test_state_revenue_adds_up_to_joined_person_spend(t):
    states = total(REPORTS["q51_state_revenue_share"](t), "state_revenue")
    persons = total(REPORTS["q62_customer_revenue_share"](t), "total_spending")
    assert states == pytest.approx(persons, rel=1e-12)


def test_running_total_ends_at_the_sum_of_months(t):
    cum = REPORTS["q61_cumulative_monthly_revenue"](t).collect()
    assert cum[-1].cumulative_revenue == pytest.approx(
        total(REPORTS["q55_monthly_revenue_growth"](t), "revenue"), rel=1e-12)


def test_one_latest_order_per_customer(t):
    latest = REPORTS["q57_latest_order_per_customer"](t)
    assert latest.count() == REPORTS["q22_orders_per_customer"](t).count()


def test_rank_report_starts_with_the_top_ten(t):
    ranked = (REPORTS["q52_rank_categories_by_revenue"](t)
              .orderBy(F.col("total_revenue").desc(), "product_category_name_english").limit(10))
    assert [tuple(r) for r in ranked.select("product_category_name_english",
                                            "total_revenue").collect()] == \
        [tuple(r) for r in REPORTS["q07_top_categories_by_revenue"](t).collect()]


def test_quartile_sizes(t):
    sizes = [r[1] for r in REPORTS["q63_spending_quartiles"](t).groupBy("spending_quartile")
             .count().orderBy("spending_quartile").collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


@pytest.mark.parametrize("name", ["q24_aov_per_seller_as_written", "q39_aov_by_payment_method",
                                  "q60_order_value_change", "q63_spending_quartiles",
                                  "q65_monthly_repeat_rate", "q66_customer_scorecard"])
def test_partitioning_does_not_change_results(t, name):
    shuffled = dataclasses.replace(
        t, items=t.items.repartition(7), payments=t.payments.repartition(5),
        orders=t.orders.repartition(3), customers=t.customers.repartition(2))
    assert sorted(REPORTS[name](t).collect()) == sorted(REPORTS[name](shuffled).collect())
