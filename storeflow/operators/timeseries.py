"""Trends over time: by year, by month, year-on-year change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money as M
from .aggregates import asc, summarize, total_profit, total_sales


def order_year(col: str = "order_date"):
    return F.year(col).cast("bigint")


def sales_by_year(sl: DataFrame) -> DataFrame:
    return summarize(sl, [order_year().alias("year")], [total_sales(), total_profit()],
                     order=[asc("year")])


def sales_by_month(sl: DataFrame) -> DataFrame:
    """Totals per calendar month; ``month`` is the month's first day."""
    return summarize(sl, [F.trunc("order_date", "MM").alias("month")],
                     [total_sales(), total_profit()], order=[asc("month")])


def yoy_growth(sl: DataFrame) -> DataFrame:
    """Sales per year and the change from the previous year present.

    The first year has no growth (NULL); missing years are not filled.
    The window runs over one row per year, so its single partition holds
    only as many rows as there are years.
    """
    yearly = sl.groupBy(order_year().alias("year")).agg(M.sum_money("sales").alias("_s"))
    w = Window.orderBy(F.col("year").asc_nulls_last())
    return yearly.select(
        "year",
        M.money(F.col("_s")).alias("sales"),
        M.money(F.col("_s") - F.lag("_s").over(w)).alias("growth"),
    )
