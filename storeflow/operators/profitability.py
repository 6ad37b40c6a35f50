"""Profit drivers: discounts, loss-making orders, geography, shipping, and
the product profitability matrix."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions.bands import band
from .aggregates import (
    asc, desc, line_count, loss_groups, performance_by, summarize, total_profit, total_sales,
)
from .products import PRODUCT_NAME, _mean_parts, at_or_above_mean

# Discount bands (first match wins) and the default band.
DISCOUNT_BANDS = [
    ("==", "0", "No Discount"),
    ("<=", "0.20", "Low Discount"),
    ("<=", "0.50", "Medium Discount"),
]
DISCOUNT_DEFAULT = "High Discount"

# Profitability quadrant labels.
QUADRANTS = (
    "High Sales / High Profit",
    "High Sales / Low Profit",
    "Low Sales / High Profit",
    "Low Sales / Low Profit",
)

HIGH_DISCOUNT = "0.30"


def discount_impact(sl: DataFrame) -> DataFrame:
    """Lines, sales, profit and mean profit per discount level."""
    return summarize(sl, ["discount"], [
        line_count(), total_sales(), total_profit(), M.mean("profit").alias("avg_profit"),
    ], order=[asc("discount")])


def discount_bands(sl: DataFrame, bands=DISCOUNT_BANDS, default: str = DISCOUNT_DEFAULT) -> DataFrame:
    """Lines, sales, profit per discount band (a NULL discount is the
    default band, as the CASE's ELSE)."""
    return summarize(sl, [band("discount", bands, default).alias("discount_group")],
                     [line_count(), total_sales(), total_profit()], order=[desc("total_sales")])


def loss_orders(sl: DataFrame) -> DataFrame:
    """Orders whose lines sum to a loss, worst first."""
    return loss_groups(sl, ["order_id"])


def worst_orders(sl: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` orders with the lowest total profit (loss or not)."""
    return summarize(sl, ["order_id"], [total_sales(), total_profit()],
                     order=[asc("total_profit"), asc("order_id")], limit=n)


def region_profitability(sl: DataFrame) -> DataFrame:
    return performance_by(sl, "region", order_by="profit_margin_pct")


def state_profitability(sl: DataFrame) -> DataFrame:
    return performance_by(sl, "state", order_by="total_profit")


def profitability_matrix(sl: DataFrame, key: Sequence[str] = PRODUCT_NAME,
                         labels: Sequence[str] = QUADRANTS) -> DataFrame:
    """Each product against the mean product sales and mean product profit.

    ``>=`` the mean is High.  The means are one scalar subquery each
    (sum and count), compared without division.  A NULL total fails both
    tests and lands in the last quadrant.
    """
    hh, hl, lh, ll = labels
    totals = sl.groupBy(*key).agg(M.sum_money("sales").alias("_s"), M.sum_money("profit").alias("_p"))
    s_parts = _mean_parts(totals, "_s")
    p_parts = _mean_parts(totals, "_p")
    hi_s = at_or_above_mean(F.col("_s"), s_parts, strict=False)
    hi_p = at_or_above_mean(F.col("_p"), p_parts, strict=False)
    lo_s = F.col("_s") * s_parts.getField("n") < s_parts.getField("g")
    lo_p = F.col("_p") * p_parts.getField("n") < p_parts.getField("g")
    quadrant = (F.when(hi_s & hi_p, hh).when(hi_s & lo_p, hl).when(lo_s & hi_p, lh).otherwise(ll))
    return totals.select(
        *key, M.money("_s").alias("total_sales"), M.money("_p").alias("total_profit"),
        quadrant.alias("profitability_segment"),
    )


def category_discount(sl: DataFrame) -> DataFrame:
    return summarize(sl, ["category"], [
        M.mean("discount").alias("avg_discount"), total_sales(), total_profit(),
    ], order=[desc("total_profit")])


def high_discount_products(sl: DataFrame, threshold: str = HIGH_DISCOUNT,
                           key: Sequence[str] = PRODUCT_NAME) -> DataFrame:
    """Products whose mean discount is at least ``threshold``; the test is
    on the unrounded mean, as ``sum >= threshold * count``."""
    return summarize(sl, list(key), [
        M.mean("discount").alias("avg_discount"),
        total_profit(),
        F.sum("discount").alias("_ds"),
        F.count("discount").alias("_dn"),
    ], having=F.col("_ds") >= F.lit(Decimal(threshold)) * F.col("_dn"),
        order=[desc("avg_discount")])
