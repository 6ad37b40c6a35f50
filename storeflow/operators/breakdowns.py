"""All one-dimensional breakdowns of the report from one scan.

The single operators (``aggregates``, ``timeseries``, ``profitability``)
scan the clean lines once each.  ``measures`` aggregates them over all
dimensions at once by ``GROUPING SETS`` into one small table (a row per
dimension and value: sums and counts that every measure can be made of);
``breakdown`` makes a report table of it.  Results equal those of the
single operators, in columns, types and values.

The table has as many rows as the dimensions have values together, so only
low- and mid-cardinality dimensions belong here; customers, products and
orders have operators of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions.bands import band
from .aggregates import asc, desc, shipping_days
from .profitability import DISCOUNT_BANDS, DISCOUNT_DEFAULT
from .timeseries import order_year

DIMENSIONS: dict[str, Callable[[], Column]] = {
    "category": lambda: F.col("category"),
    "sub_category": lambda: F.col("sub_category"),
    "region": lambda: F.col("region"),
    "state": lambda: F.col("state"),
    "ship_mode": lambda: F.col("ship_mode"),
    "discount": lambda: F.col("discount"),
    "discount_group": lambda: band("discount", DISCOUNT_BANDS, DISCOUNT_DEFAULT),
    "year": order_year,
    "month": lambda: F.trunc("order_date", "MM"),
}


def measures(sl: DataFrame, dimensions: Sequence[str] = tuple(DIMENSIONS)) -> DataFrame:
    """``dimension``, one column per dimension (NULL but in its own rows),
    lines and the sums and counts of sales, profit, discount and shipping
    days."""
    rows = sl.select(
        *[DIMENSIONS[d]().alias(d) for d in dimensions], F.col("sales").alias("_sales"), F.col("profit").alias("_profit"),
        F.col("discount").alias("_discount"), shipping_days().alias("_days"))
    sets = [[F.col(d)] for d in dimensions]
    summed = rows.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).cast("bigint").alias("lines"),
        *[M.sum_money(f"_{c}").alias(f"{c}_sum") for c in ("sales", "profit", "discount", "days")],
        *[F.count(f"_{c}").alias(f"{c}_count") for c in ("profit", "discount", "days")])
    # In a set of one column the grouping id has the bits of all others.
    every, top = (1 << len(dimensions)) - 1, len(dimensions) - 1
    name = F.create_map(*[x for i, d in enumerate(dimensions) for x in (F.lit(every - (1 << (top - i))).cast("bigint"), F.lit(d))])
    return summed.withColumn("dimension", F.element_at(name, F.col("_set"))).drop("_set")


def _money(name: str, alias: str) -> Column:
    return M.money(f"{name}_sum").alias(alias)


def _mean(name: str, alias: str) -> Column:
    total, count = F.col(f"{name}_sum").cast("decimal(18,2)"), F.nullif(F.col(f"{name}_count"), F.lit(0))
    return F.round(total / count, 2).cast("double").alias(alias)


def _margin(guard: bool = True) -> Column:
    return M.margin_pct(F.col("profit_sum"), F.col("sales_sum"), guard=guard).alias("profit_margin_pct")


@dataclass(frozen=True)
class Breakdown:
    """A report table: its dimension, columns, order, and what else ends it."""

    dimension: str
    columns: Callable[[], list[Column]]
    order: Callable[[], list[Column]] = lambda: [desc("total_sales")]
    only: Callable[[], Column] | None = None
    limit: int | None = None


def _totals() -> list[Column]:
    return [_money("sales", "total_sales"), _money("profit", "total_profit")]


def _counted() -> list[Column]:
    return [F.col("lines").alias("orders_count"), *_totals()]


BREAKDOWNS: dict[str, Breakdown] = {
    "sales_by_category": Breakdown("category", _totals),
    "sales_by_sub_category": Breakdown("sub_category", _totals),
    "sub_category_performance": Breakdown("sub_category", _totals),
    "category_performance": Breakdown("category", lambda: [*_totals(), _margin()]),
    "region_performance": Breakdown(
        "region", lambda: [_money("sales", "sales"), _money("profit", "profit"), _margin(guard=False)],
        lambda: [desc("profit_margin_pct")]),
    "region_profitability": Breakdown("region", lambda: [*_totals(), _margin()], lambda: [desc("profit_margin_pct")]),
    "state_profitability": Breakdown("state", lambda: [*_totals(), _margin()], lambda: [desc("total_profit")]),
    "top_states_by_sales": Breakdown(
        "state", lambda: [_money("sales", "total_sales")], lambda: [desc("total_sales"), asc("state")], limit=10),
    "top_states_by_profit": Breakdown(
        "state", lambda: [_money("profit", "total_profit")], lambda: [desc("total_profit"), asc("state")], limit=10),
    "loss_states": Breakdown(
        "state", _totals, lambda: [asc("total_profit"), asc("state")], only=lambda: F.col("total_profit") < 0),
    "sales_by_year": Breakdown("year", _totals, lambda: [asc("year")]),
    "sales_by_month": Breakdown("month", _totals, lambda: [asc("month")]),
    "ship_mode_summary": Breakdown("ship_mode", _counted),
    "shipping_performance": Breakdown("ship_mode", lambda: [*_counted(), _mean("days", "avg_shipping_days")]),
    "discount_impact": Breakdown(
        "discount", lambda: [*_counted(), _mean("profit", "avg_profit")], lambda: [asc("discount")]),
    "discount_bands": Breakdown("discount_group", _counted),
    "category_discount": Breakdown(
        "category", lambda: [_mean("discount", "avg_discount"), *_totals()], lambda: [desc("total_profit")]),
}


def breakdown(table: DataFrame, key: str) -> DataFrame:
    """The report table ``key`` from the (written) table of ``measures``."""
    if key == "yoy_growth":
        return _growth(table)
    if key == "revenue_share":
        return _share(table)
    b = BREAKDOWNS[key]
    out = table.where(F.col("dimension") == b.dimension).select(b.dimension, *b.columns())
    if b.only is not None:
        out = out.where(b.only())
    out = out.orderBy(*b.order())
    return out if b.limit is None else out.limit(b.limit)


def _growth(table: DataFrame) -> DataFrame:
    """Sales per year and the change from the previous year present."""
    years = Window.orderBy(F.col("year").asc_nulls_last())  # one row per year
    return table.where("dimension = 'year'").select(
        "year", _money("sales", "sales"),
        M.money(F.col("sales_sum") - F.lag("sales_sum").over(years)).alias("growth"))


def _share(table: DataFrame, dimension: str = "category") -> DataFrame:
    """Sales per value and their share of all sales, in percent."""
    own = table.where(F.col("dimension") == dimension)
    grand = own.select(F.sum("sales_sum")).scalar()
    return own.select(
        dimension, _money("sales", "total_sales"),
        M.ratio(F.col("sales_sum"), grand, factor=100).alias("share_pct")).orderBy(desc("total_sales"))


KEYS = (*BREAKDOWNS, "yoy_growth", "revenue_share")
