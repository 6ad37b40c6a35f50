"""Grouped and global aggregates over clean order lines.

``summarize`` is the one generic operator: group (or not), aggregate,
filter on aggregates (HAVING), order and limit.  Columns whose name starts
with ``_`` are helpers for HAVING / ORDER BY and are dropped from the
result.  Every breakdown, top-k and overview below is a thin call to it.

Plan shape: a partial hash aggregate in every scan task, one shuffle of
partial rows on the group key, a final aggregate.  Low-cardinality keys
(category, region, band) leave a handful of rows per task; high-
cardinality keys (order, customer, product) shuffle partial sums, which
absorbs hot keys.  ``order + limit`` plans as a per-task top-k
(``TakeOrderedAndProject``), never a full sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money as M

Key = str | Column


def summarize(
    df: DataFrame,
    keys: Sequence[Key],
    aggs: Sequence[Column],
    having: Column | None = None,
    order: Sequence[Column] | None = None,
    limit: int | None = None,
) -> DataFrame:
    grouped = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    if having is not None:
        grouped = grouped.where(having)
    if order:
        grouped = grouped.orderBy(*order)
    if limit is not None:
        grouped = grouped.limit(limit)
    helpers = [c for c in grouped.columns if c.startswith("_")]
    return grouped.drop(*helpers) if helpers else grouped


def desc(name: str) -> Column:
    """Descending with nulls first (PostgreSQL's order for DESC)."""
    return F.col(name).desc_nulls_first()


def asc(name: str) -> Column:
    """Ascending with nulls last (PostgreSQL's order for ASC)."""
    return F.col(name).asc_nulls_last()


# ---------------------------------------------------------------- measures


def total_sales(alias: str = "total_sales") -> Column:
    return M.money(M.sum_money("sales")).alias(alias)


def total_profit(alias: str = "total_profit") -> Column:
    return M.money(M.sum_money("profit")).alias(alias)


def line_count(alias: str = "orders_count") -> Column:
    """``COUNT(*)``: a count of lines, whatever the alias says."""
    return F.count(F.lit(1)).cast("bigint").alias(alias)


def distinct_count(col: str, alias: str, exact: bool = True, rsd: float = 0.01) -> Column:
    """``COUNT(DISTINCT col)``.  ``exact=False`` opts into HyperLogLog++
    (relative standard deviation ``rsd``): no shuffle of distinct values,
    for dashboards over very large tables.  The analyses are exact."""
    c = F.count_distinct(F.col(col)) if exact else F.approx_count_distinct(F.col(col), rsd)
    return c.cast("bigint").alias(alias)


def margin(alias: str = "profit_margin_pct", guard: bool = True) -> Column:
    return M.margin_pct(M.sum_money("profit"), M.sum_money("sales"), guard=guard).alias(alias)


def shipping_days() -> Column:
    return F.datediff(F.col("ship_date"), F.col("order_date"))


def mean_shipping_days(alias: str = "avg_shipping_days") -> Column:
    return M.mean(shipping_days()).alias(alias)


# ---------------------------------------------------------------- overviews


def business_overview(sl: DataFrame, exact: bool = True) -> DataFrame:
    """Sales, profit, order / customer / product counts, margin (1 row).

    The three exact distinct counts plan as one scan with an ``Expand``
    (one copy of each line per distinct column) feeding a partial
    aggregate on (column id, value).  One scalar subquery per count was
    measured slower here and does the same work at scale: every line
    still passes one aggregate per distinct column, and every column is
    read once either way.
    """
    return summarize(sl, [], [
        total_sales(),
        total_profit(),
        distinct_count("order_id", "total_orders", exact),
        distinct_count("customer_id", "total_customers", exact),
        distinct_count("product_id", "total_products", exact),
        margin(),
    ])


def average_order_value(sl: DataFrame, strict: bool = True) -> DataFrame:
    """Sales per distinct order, rounded to cents; no orders at all raise
    unless ``strict=False`` (then NULL)."""
    value = M.ratio(M.sum_money("sales"), F.count_distinct("order_id"), guard=not strict)
    return summarize(sl, [], [value.alias("average_order_value")])


def customer_overview(sl: DataFrame, exact: bool = True) -> DataFrame:
    return summarize(sl, [], [
        distinct_count("customer_id", "total_customers", exact), total_sales(), total_profit(),
    ])


def product_overview(sl: DataFrame, exact: bool = True) -> DataFrame:
    return summarize(sl, [], [
        distinct_count("product_id", "total_products", exact), total_sales(), total_profit(),
    ])


def avg_shipping_days(sl: DataFrame) -> DataFrame:
    return summarize(sl, [], [mean_shipping_days()])


# ---------------------------------------------------------------- breakdowns


def sales_by(sl: DataFrame, dim: str) -> DataFrame:
    """Sales and profit per value of ``dim``, best-selling first."""
    return summarize(sl, [dim], [total_sales(), total_profit()], order=[desc("total_sales")])


def performance_by(sl: DataFrame, dim: str, order_by: str = "total_sales") -> DataFrame:
    """Sales, profit and (zero-guarded) margin per value of ``dim``."""
    return summarize(
        sl, [dim], [total_sales(), total_profit(), margin()], order=[desc(order_by)]
    )


def region_performance(sl: DataFrame, strict: bool = True) -> DataFrame:
    """Margin per region, best margin first.

    The margin has no zero guard unless ``strict=False``: a region whose
    sales sum to zero raises, as the division does in PostgreSQL.
    """
    return summarize(
        sl,
        ["region"],
        [
            M.money(M.sum_money("sales")).alias("sales"),
            M.money(M.sum_money("profit")).alias("profit"),
            margin(guard=not strict),
        ],
        order=[desc("profit_margin_pct")],
    )


def top_by(sl: DataFrame, keys: Sequence[str], measure: Column, name: str,
           n: int = 10, ascending: bool = False) -> DataFrame:
    """The ``n`` groups with the highest (or lowest) ``measure``.

    Ties are broken by the group keys so that the result is repeatable.
    """
    first = asc(name) if ascending else desc(name)
    return summarize(sl, keys, [measure.alias(name)],
                     order=[first, *[asc(k) for k in keys]], limit=n)


def loss_groups(sl: DataFrame, keys: Sequence[str], with_sales: bool = True,
                n: int | None = None) -> DataFrame:
    """Groups whose total profit is negative, worst first."""
    aggs = ([total_sales()] if with_sales else []) + [total_profit()]
    order = [asc("total_profit"), *[asc(k) for k in keys]]
    return summarize(sl, keys, aggs, having=F.col("total_profit") < 0, order=order, limit=n)


def ship_mode_summary(sl: DataFrame) -> DataFrame:
    return summarize(sl, ["ship_mode"], [line_count(), total_sales(), total_profit()],
                     order=[desc("total_sales")])


def shipping_performance(sl: DataFrame) -> DataFrame:
    return summarize(
        sl, ["ship_mode"],
        [line_count(), total_sales(), total_profit(), mean_shipping_days()],
        order=[desc("total_sales")],
    )


def revenue_share(sl: DataFrame, dim: str = "category") -> DataFrame:
    """Sales per value of ``dim`` and its share of all sales, in percent.

    The grand total is a scalar subquery (one value, computed once).
    """
    grand = sl.select(M.sum_money("sales")).scalar()
    per = sl.groupBy(dim).agg(M.sum_money("sales").alias("_s"))
    return per.select(
        dim,
        M.money(F.col("_s")).alias("total_sales"),
        M.ratio(F.col("_s"), grand, factor=100).alias("share_pct"),
    ).orderBy(desc("total_sales"))
