"""Hand-made model tables with results worked out by hand.

Covers the source's quirks: seller-order join on order_id only (Q24),
payment-row weighting (Q39), all-payments vs joined total (Q51 / Q62),
review-row thresholds (Q38), NULL delivery dates as 'On-Time' (Q49), NULL
means sorting first (Q18), same-day lateness (Q45), day differences across
midnight (Q16), pooled categories (Q32), untranslated and NULL categories,
no calendar spine (Q55, Q56), repeat customers (Q65), timestamp ties (Q57),
binary city comparison (Q59), exact half-up rounding (Q6), empty tables.
"""

import dataclasses
from datetime import datetime as T
from decimal import Decimal as D

import pytest

from mercato.operators import integrity
from mercato.reports import REPORTS
from mercato.reports import advanced, customers, delivery, overview, payments, reviews
from mercato.reports import revenue, sellers
from mercato.sources.model import from_frames

ROWS = {
    "customers": [
        ("c1", "p1", None, "São Paulo", "SP"),
        ("c2", "p1", None, "Rio", "RJ"),
        ("c3", "p2", None, "sao paulo", "SP"),
        ("c4", "p3", None, "Rio", "RJ"),
    ],
    "orders": [
        ("o1", "c1", "delivered", T(2020, 1, 10, 23, 59, 59), None, None,
         T(2020, 1, 11, 0, 0, 1), T(2020, 1, 20)),
        ("o2", "c1", "delivered", T(2020, 1, 15, 10), None, None, None, T(2020, 1, 30)),
        ("o3", "c2", "delivered", T(2020, 3, 5, 8), None, None,
         T(2020, 3, 20, 15), T(2020, 3, 20)),
        ("o4", "c3", "shipped", T(2020, 3, 7), None, None, T(2020, 3, 9), T(2020, 3, 30)),
        ("o5", "c4", "delivered", T(2020, 1, 20, 12), None, None,
         T(2020, 1, 25), T(2020, 2, 1)),
        ("o6", "c4", "canceled", T(2020, 1, 20, 12), None, None, None, T(2020, 2, 1)),
    ],
    "sellers": [("s1", None, "X", "SP"), ("s2", None, "Y", "RJ"), ("s3", None, "Z", "RJ"),
                ("s4", None, "W", "SP")],
    "products": [
        ("pA", "beleza", None, None, None, None, None, None, None),
        ("pB", "beleza2", None, None, None, None, None, None, None),
        ("pC", None, None, None, None, None, None, None, None),
        ("pD", "untranslated_cat", None, None, None, None, None, None, None),
    ],
    "product_category_name_translation": [("beleza", "beauty"), ("beleza2", "beauty")],
    "order_items": [
        ("o1", 1, "pA", "s1", None, D("10.00"), D("1.00")),
        ("o1", 2, "pB", "s2", None, D("20.00"), D("2.00")),
        ("o1", 3, "pA", "s1", None, D("30.00"), D("3.00")),
        ("o2", 1, "pA", "s4", None, D("1.00"), D("0.10")),
        ("o3", 1, "pC", "s1", None, D("5.00"), D("0.50")),
        ("o4", 1, "pD", "s2", None, D("7.00"), D("0.70")),
        ("o5", 1, "pB", "s3", None, D("100.00"), D("5.00")),
    ],
    "order_payments": [
        ("o1", 1, "credit_card", 2, D("40.00")),
        ("o1", 2, "voucher", 1, D("20.00")),
        ("o1", 3, "credit_card", 1, D("10.00")),
        ("o3", 1, "boleto", 1, D("5.50")),
        ("o5", 1, "credit_card", 3, D("105.00")),
        ("o9", 1, "boleto", 1, D("1000.00")),  # no such order
    ],
    "order_reviews": [
        ("r1", "o1", 5, None, None, None, None),
        ("r2", "o1", 3, None, None, None, None),
        ("r3", "o3", 1, None, None, None, None),
        ("r4", "o5", 4, None, None, None, None),
    ],
}


@pytest.fixture(scope="module")
def t(spark):
    return from_frames(spark, ROWS)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_q1_counts(t):
    got = {k: v.collect()[0][0] for k, v in overview.entity_counts(t).items()}
    assert got == {"total_customers": 4, "total_sellers": 4, "total_products": 4,
                   "total_orders": 6, "total_categories": 2}


def test_q6_half_up_rounding(t):
    # order totals 70, 5.5, 105, 1000 -> mean 295.125 -> 295.13
    assert rows(revenue.average_order_value(t)) == [(295.13,)]


def test_q7_pooled_english_category(t):
    assert rows(revenue.top_categories_by_revenue(t)) == [("beauty", 161.0)]


def test_q4_untranslated_and_null_categories_vanish(t):
    assert rows(overview.top_categories_by_product_count(t)) == [("beauty", 2)]


def test_q16_day_difference_across_midnight(t):
    # o1: 1 day (one second across midnight), o2 undated (ignored), o3: 15, o5: 5
    assert rows(delivery.avg_delivery_days(t)) == [(7.0,)]


def test_q18_null_mean_sorts_first(t):
    got = delivery.fastest_sellers(t).collect()
    assert [tuple(r) for r in got] == [("s4", None), ("s2", 1.0), ("s3", 5.0),
                                       ("s1", pytest.approx(17 / 3))]


def test_q24_join_on_order_only(t):
    got = dict(rows(sellers.aov_per_seller_as_written(t)))
    assert got == {"s1": 25.0, "s2": pytest.approx(67 / 3), "s3": 100.0, "s4": 1.0}


def test_q32_category_order_means_pool(t):
    # (beleza,o1)=40, (beleza,o2)=1, (beleza2,o1)=20, (beleza2,o5)=100
    assert rows(revenue.avg_category_revenue_per_order(t)) == [("beauty", 40.25)]


def test_q35_raw_categories_null_not_counted(t):
    got = dict(rows(sellers.top_sellers_by_category_breadth(t)))
    assert got == {"s1": 1, "s2": 2, "s3": 1, "s4": 1}


def test_q38_threshold_counts_review_rows(t):
    assert rows(reviews.avg_review_by_state_min_reviews(t, min_reviews=2)) == [
        ("RJ", 2.5), ("SP", 4.0)]
    assert rows(reviews.avg_review_by_state_min_reviews(t, min_reviews=3)) == []


def test_q39_weights_by_payment_rows(t):
    got = dict(rows(payments.aov_by_payment_method(t)))
    assert got == {"credit_card": pytest.approx(245 / 3), "voucher": 70.0, "boleto": 502.75}


def test_q45_late_on_the_estimated_day_is_zero_days(t):
    assert rows(delivery.avg_delay_days_by_state(t)) == [("RJ", 0.0)]


def test_q48_undated_counts_in_denominator_only(t):
    assert rows(delivery.monthly_delay_rate(t)) == [(2020, 1, 0.0), (2020, 3, 100.0)]


def test_q49_undated_is_on_time(t):
    assert rows(reviews.review_score_by_delivery_status(t)) == [
        ("Delayed", 1, 1.0), ("On-Time", 3, 4.0)]


def test_q50_gap_in_calendar_days(t):
    got = rows(customers.purchase_gap(t))
    assert [(r[0], r[3]) for r in got] == [("p1", 55), ("p3", 0)]


def test_q51_total_includes_unmatched_payments(t):
    assert rows(revenue.state_revenue_share(t)) == [
        ("RJ", 110.5, 1180.5, 9.36), ("SP", 70.0, 1180.5, 5.93)]


def test_q62_total_is_joined_rows_only(t):
    assert rows(advanced.customer_revenue_share(t)) == [("p1", 75.5, 41.83), ("p3", 105.0, 58.17)]


def test_q55_q56_previous_present_month(t):
    assert rows(advanced.monthly_revenue_growth(t)) == [
        ("2020-01", 175.0, None, None), ("2020-03", 5.5, 175.0, -96.86)]
    assert rows(advanced.monthly_order_growth(t)) == [
        ("2020-01", 4, None, None), ("2020-03", 2, 4, -50.0)]


def test_q57_timestamp_tie_takes_largest_order_id(t):
    got = {r[0]: r[1] for r in rows(advanced.latest_order_per_customer(t))}
    assert got == {"c1": "o2", "c2": "o3", "c3": "o4", "c4": "o6"}


def test_q59_city_names_compare_binary(t):
    assert rows(advanced.top_spenders_per_city(t)) == [
        ("Rio", "p1", 5.5, 2), ("Rio", "p3", 105.0, 1), ("São Paulo", "p1", 70.0, 1)]


def test_q63_tiles(t):
    assert rows(advanced.spending_quartiles(t)) == [("p1", 75.5, 1), ("p3", 105.0, 2)]


def test_q64_state_average(t):
    assert rows(advanced.spend_vs_state_average(t)) == [
        ("p1", "RJ", 5.5, 55.25, -49.75), ("p1", "SP", 70.0, 70.0, 0.0),
        ("p3", "RJ", 105.0, 55.25, 49.75)]


def test_q65_repeat_means_first_order_before_the_month(t):
    assert rows(advanced.monthly_repeat_rate(t)) == [("2020-01", 2, 0, 0.0),
                                                     ("2020-03", 2, 1, 50.0)]


def test_q66_scorecard(t):
    got = rows(advanced.customer_scorecard(t))
    assert [(r[0], r[1], r[2], r[3], r[4], r[7]) for r in got] == [
        ("p1", "Rio", 1, 5.5, 5.5, 2), ("p1", "São Paulo", 1, 70.0, 23.33, 1),
        ("p3", "Rio", 1, 105.0, 105.0, 1)]


def test_empty_tables_keep_schemas(spark):
    empty = from_frames(spark, {})
    for name, report in REPORTS.items():
        df = report(empty)
        got = df.collect()
        if name.startswith("q01") or name in ("q02_dataset_period", "q06_average_order_value",
                                              "q16_avg_delivery_days"):
            assert len(got) == 1, name  # global aggregates give one row
        elif name == "integrity_report":
            assert got and all(r.violations == 0 for r in got)  # one row per constraint
        else:
            assert got == [], name


def test_integrity_checks(spark):
    bad = from_frames(spark, {
        "order_payments": [("o1", 1, "x", 1, D("1.00")), ("o1", 1, "y", 1, D("2.00"))],
        "orders": [("o2", "c9", None, None, None, None, None, None)],
    })
    assert rows(integrity.duplicate_keys(bad.payments, ["order_id", "payment_sequential"])) == [
        ("o1", 1, 2)]
    assert len(integrity.orphans(bad.payments, bad.orders, "order_id").collect()) == 2
    assert len(integrity.orphans(bad.orders, bad.customers, "customer_id").collect()) == 1
    report = {(r.check, r.table_name): r.violations
              for r in integrity.integrity_report(bad).collect()}
    assert report[("duplicate_key", "order_payments")] == 1
    assert report[("orphan", "order_payments")] == 2
    assert report[("not_null", "orders")] == 0


def test_optional_city_collation_merges_spellings(t):
    from mercato.plans.facts import with_city_collation
    merged = with_city_collation(t, "UNICODE_CI_AI")
    cities = dict(rows(merged.customers.select("customer_id", "customer_city")))
    assert cities == {"c1": "São Paulo", "c2": "Rio", "c3": "São Paulo", "c4": "Rio"}
    assert rows(advanced.top_spenders_per_city(t, city_collation="UNICODE_CI_AI")) == \
        rows(advanced.top_spenders_per_city(t))


def test_q25_q27_item_by_review_fan_out(t):
    # o1: two items of pA (beleza) and one of pB (beleza2) x reviews 5 and 3;
    # o5: pB x review 4; o2 and o4 have no review; pC has no category
    assert rows(reviews.avg_review_by_category(t)) == [("beauty", 4.0)]
    assert rows(reviews.avg_review_by_state(t)) == [("RJ", 2.5), ("SP", 4.0)]


def test_q26_q37_seller_reviews_and_distinct_order_threshold(t):
    # s1: 2 items x (5, 3) on o1 + 1 item x (1) on o3 -> 17 / 5
    assert rows(reviews.avg_review_by_seller(t)) == [("s1", 3.4), ("s2", 4.0), ("s3", 4.0)]
    assert rows(reviews.avg_review_by_seller_min_orders(t, min_orders=2)) == [("s1", 3.4)]


def test_limit_ties_cut_by_key(t):
    # units: s1 3, s2 2, s3 1, s4 1 -> the third place goes to s3
    assert [tuple(r) for r in revenue.top_sellers_by_units(t, n=3).collect()] == [
        ("s1", 3), ("s2", 2), ("s3", 1)]


def test_null_in_not_null_column_is_reported(spark):
    df = spark.createDataFrame([(None, 1), ("o1", None), ("o2", 2)],
                               "order_id string, order_item_id int")
    assert len(integrity.null_violations(df, ["order_id", "order_item_id"]).collect()) == 2


def test_growth_after_a_zero_month_is_null(spark):
    from mercato.operators.timeseries import period_growth
    months = spark.createDataFrame([("2020-01", 0), ("2020-02", 10), ("2020-04", 5)],
                                   "yearmonth string, n long")
    got = rows(period_growth(months, "yearmonth", "n", "prev", "growth"))
    assert got == [("2020-01", 0, None, None), ("2020-02", 10, 0, None),
                   ("2020-04", 5, 10, -50.0)]


def _orders(n, customer="c1", day=T(2020, 1, 1)):
    return [(f"k{i}", customer, "delivered", day, None, None, T(2020, 1, 3), T(2020, 2, 1))
            for i in range(n)]


def test_rank_ties_at_ranks_1_3_and_5(spark):
    # spends 9, 9, 8, 7, 7, 6, 5, 5, 4: dense ranks 1 1 2 3 3 4 5 5 6
    spends = [9, 9, 8, 7, 7, 6, 5, 5, 4]
    n = len(spends)
    t = from_frames(spark, {
        "customers": [(f"c{i}", f"p{i}", None, "City", "ST") for i in range(n)],
        "orders": [(f"o{i}", f"c{i}", "delivered", T(2020, 1, 1), None, None, None, None) for i in range(n)],
        "order_payments": [(f"o{i}", 1, "x", 1, D(v)) for i, v in enumerate(spends)],
        "order_items": [(f"o{i}", 1, f"g{i}", f"s{i}", None, D(v), D(0)) for i, v in enumerate(spends)],
        "products": [(f"g{i}", f"cat{i}", *[None] * 7) for i in range(n)],
        "product_category_name_translation": [(f"cat{i}", f"en{i}") for i in range(n)],
    })
    assert rows(advanced.top_spenders(t)) == [(f"p{i}", float(v)) for i, v in enumerate(spends) if v >= 5]
    assert [(r[1], r[3]) for r in rows(advanced.top_spenders_per_city(t))] == [
        ("p0", 1), ("p1", 1), ("p2", 2), ("p3", 3), ("p4", 3)]
    assert [(r[1], r[3]) for r in rows(advanced.top_seller_per_state(t))] == [("s0", 1), ("s1", 1)]
    assert [(r[1], r[3]) for r in rows(advanced.top_categories_per_state(t))] == [
        ("en0", 1), ("en1", 1), ("en2", 2), ("en3", 3), ("en4", 3)]
    assert [r[7] for r in sorted(advanced.customer_scorecard(t).collect())] == [1, 1, 2, 3, 3, 4, 5, 5, 6]


def test_thresholds_count_distinct_orders(spark):
    # s50: 50 orders of one item; s49: 49 orders, one of them with three items
    items = [(f"k{i}", 1, "pA", "s50", None, D("1.00"), D("2.00")) for i in range(50)]
    items += [(f"k{i}", 2, "pA", "s49", None, D("1.00"), D("9.00")) for i in range(49)]
    items += [("k0", 3, "pA", "s49", None, D("1.00"), D("9.00")), ("k0", 4, "pA", "s49", None, D("1.00"), D("9.00"))]
    t = from_frames(spark, {"orders": _orders(50), "order_items": items})
    assert rows(sellers.avg_freight_per_order_by_seller(t)) == [("s50", 2.0)]
    assert rows(delivery.top_sellers_by_delivered(t)) == [("s50", 50)]
    assert rows(delivery.fastest_sellers_min_orders(t)) == [("s50", 2.0)]
    # shown are item rows, the threshold is on orders
    assert rows(delivery.top_sellers_by_delivered(t, min_orders=49)) == [("s49", 51), ("s50", 50)]


def test_q60_timestamp_ties_go_by_order_id(spark):
    t = from_frames(spark, {
        "customers": [("c1", "p1", None, "X", "Y"), ("c2", "p1", None, "X", "Y"), ("c3", "p2", None, "X", "Y")],
        "orders": [(f"o{i}", c, "delivered", T(2020, 1, 1), None, None, None, None)
                   for i, c in enumerate(["c1", "c2", "c1", "c3"])],
        "order_payments": [(f"o{i}", 1, "x", 1, D(v)) for i, v in enumerate([1, 10, 100, 1000])],
    })
    assert [(r[0], r[1], r[3], r[4], r[5]) for r in rows(advanced.order_value_change(t))] == [
        ("p1", "o1", 10.0, 1.0, 9.0), ("p1", "o2", 100.0, 10.0, 90.0)]


def test_collation_merges_the_ranks_of_two_spellings(spark):
    t = from_frames(spark, {
        "customers": [("c1", "p1", None, "São Paulo", "SP"), ("c2", "p2", None, "sao paulo", "SP")],
        "orders": [(f"o{i}", f"c{i}", "delivered", T(2020, 1, i), None, None, None, None) for i in (1, 2)],
        "order_payments": [("o1", 1, "x", 1, D(5)), ("o2", 1, "x", 1, D(7))],
    })
    assert [(r[0], r[1], r[3]) for r in rows(advanced.top_spenders_per_city(t))] == [
        ("São Paulo", "p1", 1), ("sao paulo", "p2", 1)]
    assert [(r[0], r[1], r[3]) for r in rows(advanced.top_spenders_per_city(t, city_collation="UNICODE_CI_AI"))] == [
        ("São Paulo", "p1", 2), ("São Paulo", "p2", 1)]
    assert [(r[0], r[1], r[7]) for r in rows(advanced.customer_scorecard(t, city_collation="UNICODE_CI_AI"))] == [
        ("p1", "São Paulo", 2), ("p2", "São Paulo", 1)]
    assert [r[7] for r in rows(advanced.customer_scorecard(t))] == [1, 1]


def test_q26_q37_an_order_listed_twice_counts_once_and_weighs_alike(t):
    twice = dataclasses.replace(t, orders=t.orders.unionByName(t.orders))
    for least in (1, 2):
        assert rows(reviews.avg_review_by_seller_min_orders(twice, least)) == rows(
            reviews.avg_review_by_seller_min_orders(t, least))
    assert rows(reviews.avg_review_by_seller(twice)) == rows(reviews.avg_review_by_seller(t)) != []
