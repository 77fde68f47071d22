"""The 66 reports (70 result sets) as functions of ``Tables``.

``REPORTS`` maps a stable key to a callable ``(Tables) -> DataFrame`` with
the default parameters of the source (top 10, thresholds 50 / 100 / 5 / 2,
k = 1 / 3 / 5, four tiles).  Call the functions directly for other values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from mercato.reports import (advanced, customers, delivery, integrity, overview, payments,
                             reviews, revenue, sellers)
from mercato.sources.model import Tables


def _q1(part: str) -> Callable[[Tables], DataFrame]:
    return lambda t: overview.entity_counts(t)[part]


REPORTS: dict[str, Callable[[Tables], DataFrame]] = {
    "q01a_total_customers": _q1("total_customers"),
    "q01b_total_sellers": _q1("total_sellers"),
    "q01c_total_products": _q1("total_products"),
    "q01d_total_orders": _q1("total_orders"),
    "q01e_total_categories": _q1("total_categories"),
    "q02_dataset_period": overview.dataset_period,
    "q03_order_status_distribution": overview.order_status_distribution,
    "q04_top_categories_by_product_count": overview.top_categories_by_product_count,
    "q05_top_sellers_by_unique_products": overview.top_sellers_by_unique_products,
    "q06_average_order_value": revenue.average_order_value,
    "q07_top_categories_by_revenue": revenue.top_categories_by_revenue,
    "q08_top_customers_by_spend": revenue.top_customers_by_spend,
    "q09_top_sellers_by_revenue": revenue.top_sellers_by_revenue,
    "q10_top_states_by_sales": revenue.top_states_by_sales,
    "q11_top_categories_by_avg_price": revenue.top_categories_by_avg_price,
    "q12_top_categories_by_units": revenue.top_categories_by_units,
    "q13_top_sellers_by_units": revenue.top_sellers_by_units,
    "q14_orders_by_calendar_month": delivery.orders_by_calendar_month,
    "q15_busiest_weekday": delivery.busiest_weekday,
    "q16_avg_delivery_days": delivery.avg_delivery_days,
    "q17_avg_delivery_days_by_state": delivery.avg_delivery_days_by_state,
    "q18_fastest_sellers": delivery.fastest_sellers,
    "q19_avg_delivery_days_by_category": delivery.avg_delivery_days_by_category,
    "q20_payment_method_usage": payments.payment_method_usage,
    "q21_avg_installments_by_method": payments.avg_installments_by_method,
    "q22_orders_per_customer": customers.orders_per_customer,
    "q23_aov_per_customer": customers.aov_per_customer,
    "q24_aov_per_seller_as_written": sellers.aov_per_seller_as_written,
    "q25_avg_review_by_category": reviews.avg_review_by_category,
    "q26_avg_review_by_seller": reviews.avg_review_by_seller,
    "q27_avg_review_by_state": reviews.avg_review_by_state,
    "q28_monthly_sales": revenue.monthly_sales,
    "q29_monthly_aov": revenue.monthly_aov,
    "q30_revenue_by_payment_method": payments.revenue_by_payment_method,
    "q31_aov_by_state": revenue.aov_by_state,
    "q32_avg_category_revenue_per_order": revenue.avg_category_revenue_per_order,
    "q33_top_sellers_by_orders": sellers.top_sellers_by_orders,
    "q34_top_customers_by_distinct_sellers": customers.top_customers_by_distinct_sellers,
    "q35_top_sellers_by_category_breadth": sellers.top_sellers_by_category_breadth,
    "q36_top_categories_by_distinct_customers": sellers.top_categories_by_distinct_customers,
    "q37_avg_review_by_seller_min_orders": reviews.avg_review_by_seller_min_orders,
    "q38_avg_review_by_state_min_reviews": reviews.avg_review_by_state_min_reviews,
    "q39_aov_by_payment_method": payments.aov_by_payment_method,
    "q40_top_sellers_by_freight": sellers.top_sellers_by_freight,
    "q41_avg_delivery_days_by_category_any_status":
        delivery.avg_delivery_days_by_category_any_status,
    "q42_avg_delivery_days_by_calendar_month": delivery.avg_delivery_days_by_calendar_month,
    "q43_avg_freight_per_order_by_seller": sellers.avg_freight_per_order_by_seller,
    "q44_avg_items_per_order_by_customer": customers.avg_items_per_order_by_customer,
    "q45_avg_delay_days_by_state": delivery.avg_delay_days_by_state,
    "q46_top_sellers_by_delivered": delivery.top_sellers_by_delivered,
    "q47_fastest_sellers_min_orders": delivery.fastest_sellers_min_orders,
    "q48_monthly_delay_rate": delivery.monthly_delay_rate,
    "q49_review_score_by_delivery_status": reviews.review_score_by_delivery_status,
    "q50_purchase_gap": customers.purchase_gap,
    "q51_state_revenue_share": revenue.state_revenue_share,
    "q52_rank_categories_by_revenue": advanced.rank_categories_by_revenue,
    "q53_top_seller_per_state": advanced.top_seller_per_state,
    "q54_top_categories_per_state": advanced.top_categories_per_state,
    "q55_monthly_revenue_growth": advanced.monthly_revenue_growth,
    "q56_monthly_order_growth": advanced.monthly_order_growth,
    "q57_latest_order_per_customer": advanced.latest_order_per_customer,
    "q58_top_spenders": advanced.top_spenders,
    "q59_top_spenders_per_city": advanced.top_spenders_per_city,
    "q60_order_value_change": advanced.order_value_change,
    "q61_cumulative_monthly_revenue": advanced.cumulative_monthly_revenue,
    "q62_customer_revenue_share": advanced.customer_revenue_share,
    "q63_spending_quartiles": advanced.spending_quartiles,
    "q64_spend_vs_state_average": advanced.spend_vs_state_average,
    "q65_monthly_repeat_rate": advanced.monthly_repeat_rate,
    "q66_customer_scorecard": advanced.customer_scorecard,
    "integrity_duplicate_item_keys": integrity.duplicate_item_keys,
    "integrity_orphan_product_categories": integrity.orphan_product_categories,
    "integrity_orphan_payments": integrity.orphan_payments,
    "integrity_null_violations_items": integrity.null_violations_items,
    "integrity_report": integrity.constraint_summary,
}

__all__ = ["REPORTS"]
