"""Exact numeric helpers.

Money is summed as exact decimals and converted to double only in the last
projection.  Means are ``double(sum) / count`` so that an empty or all-NULL
group is NULL.  Rounded ratios are computed in exact integer arithmetic
(half away from zero), so a percentage never depends on binary floating
point: round(v, d) for v = num / den is
    sign * ((2 * 10^d * |num| + |den|) div (2 * |den|)) / 10^d.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

_EXACT = "decimal(38,0)"


def _c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double(col: ColumnOrName) -> Column:
    return _c(col).cast("double")


def as_long(col: ColumnOrName) -> Column:
    return _c(col).cast("bigint")


def cents(money: ColumnOrName) -> Column:
    """A two-decimal money value as an exact integer number of cents."""
    return (_c(money) * 100).cast(_EXACT)


def mean(total: ColumnOrName, count: ColumnOrName) -> Column:
    """double(total) / count; NULL when the count is 0."""
    return F.try_divide(as_double(total), _c(count))


def rounded_ratio(num: ColumnOrName, den: ColumnOrName, digits: int = 2) -> Column:
    """round(num / den, digits), half away from zero, from exact integer inputs.

    ``num`` and ``den`` must hold integral values (counts, cents).  The result
    is a double; NULL when either input is NULL or ``den`` is 0.
    """
    scale = 10 ** digits
    n, d = _c(num).cast(_EXACT), _c(den).cast(_EXACT)
    an, ad = F.abs(n), F.abs(d)
    # integral division (SQL ``div``) of exact decimals; the quotient is the
    # rounded value times 10^digits, small enough for a long.
    q = F.when(ad != 0, F.call_function("div", an * (2 * scale) + ad, ad * 2))
    signed = F.when((n < 0) != (d < 0), -q).otherwise(q)
    return as_double(signed) / scale


def percent_of(part: ColumnOrName, whole: ColumnOrName, digits: int = 2) -> Column:
    """round(part * 100 / whole, digits) from exact integral inputs (counts,
    cents); NULL when ``whole`` is 0."""
    return rounded_ratio(_c(part) * 100, whole, digits)
