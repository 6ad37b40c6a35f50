"""Exact money arithmetic as Column expressions.

Money stays decimal end to end and is rounded once, half away from zero
(Spark's ``round`` on decimals).  Means are ``sum / count`` on decimals,
never ``avg`` followed by ``round`` (``avg`` would round at six places
first).  Every ratio casts both sides to ``decimal(18,2)`` before the
division so that Spark keeps 20 fractional digits in the quotient.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MONEY_OUT, RATIO_OUT

_DEC = "decimal(18,2)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money(x: Column | str) -> Column:
    """Round to cents and give the shared money result type."""
    return F.round(_c(x), 2).cast(MONEY_OUT)


def sum_money(x: Column | str, scale: int = 2) -> Column:
    """Exact sum of a column whose values have at most ``scale`` places.

    Summed as integer units of the last place (a fixed-width ``long``
    buffer, which the hash aggregate keeps in its fast path), then scaled
    back to a decimal.  A value with more places raises (round it first, or
    give a larger ``scale``); a double counts as the decimal it prints as.
    ANSI mode raises on ``long`` overflow (above 9.2e16 in money), so the
    result is exact or an error, never wrong.
    """
    value = _c(x)
    exact = value.cast(f"decimal(18,{scale})")
    units = (exact * F.lit(10**scale)).cast("long")
    more = F.raise_error(F.concat(F.lit(f"more than {scale} decimal places: "), value.cast("string"))).cast("long")
    back = F.lit(Decimal(1).scaleb(-scale))
    return F.sum(F.when(exact != value, more).otherwise(units)).cast("decimal(20,0)") * back


def ratio(num: Column, den: Column, factor: int = 1, guard: bool = True) -> Column:
    """``round(num / den * factor, 2)`` as double, exact until the rounding.

    ``guard`` turns a zero denominator into NULL (``NULLIF``); without it a
    zero denominator raises under ANSI mode, as PostgreSQL does.
    """
    d = den.cast(_DEC)
    if guard:
        d = F.nullif(d, F.lit(0).cast(_DEC))
    q = num.cast(_DEC) / d
    if factor != 1:
        q = q * F.lit(factor)
    return F.round(q, 2).cast(RATIO_OUT)


def mean(x: Column | str) -> Column:
    """Rounded mean of a decimal or integer column (nulls skipped).

    ``sum / count`` on decimals, one rounding; NULL when no value.
    """
    c = _c(x)
    return F.round(sum_money(c).cast(_DEC) / F.nullif(F.count(c), F.lit(0)), 2).cast(RATIO_OUT)


def margin_pct(profit: Column, sales: Column, guard: bool = True) -> Column:
    """Profit margin in percent, rounded to 2 places."""
    return ratio(profit, sales, factor=100, guard=guard)
