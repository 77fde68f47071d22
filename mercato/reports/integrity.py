"""Integrity checks of the declared keys, registered as queries."""

from mercato.operators.integrity import (duplicate_keys, integrity_report, null_violations,
                                         orphans)
from mercato.reports._common import *  # noqa: F401,F403


def duplicate_item_keys(t: Tables) -> DataFrame:
    """(order_id, order_item_id) values that occur more than once."""
    return duplicate_keys(t.items, ["order_id", "order_item_id"])


def orphan_product_categories(t: Tables) -> DataFrame:
    """Products whose non-NULL category has no translation row."""
    return orphans(t.products, t.translation, "product_category_name").select(
        "product_id", "product_category_name")


def orphan_payments(t: Tables) -> DataFrame:
    """Payment rows whose order is missing."""
    return orphans(t.payments, t.orders, "order_id").select("order_id", "payment_sequential")


def null_violations_items(t: Tables) -> DataFrame:
    """Item rows with a NULL in a NOT NULL key column."""
    return null_violations(t.items, ["order_id", "order_item_id"]).select(
        "order_id", "order_item_id")


def constraint_summary(t: Tables) -> DataFrame:
    """One row per declared key, foreign key and NOT NULL set, with its
    violation count."""
    return integrity_report(t)
