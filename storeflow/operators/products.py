"""Product analyses: rankings, best per category, ABC classes, Pareto.

Two product grains occur: by name only (best per category, above
average, ABC) and by id + name (top lists, ranking, Pareto).  Each
operator takes ``key=`` with the grain as default.

Class bounds are compared exactly: an item is in class A when its
cumulative sales *including itself* are at most 80 % of the total, tested
without dividing (the comparison turns round for a negative total).  The
items within a bound are those down to one total, the cut, which
``selection.share_cuts`` finds by counting: no sort and no cumulative sums.
Items with no sales (NULL) fall to the last class.  A grand total of 0
makes the share undefined: an error, or NULL with ``strict=False``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money as M
from ..sources.storage import materialize
from . import ordered as O
from . import selection as S
from .aggregates import (  # noqa: F401  (product_overview is re-exported)
    asc, desc, loss_groups, performance_by, product_overview, sales_by, top_by,
)

PRODUCT = ["product_id", "product_name"]
PRODUCT_NAME = ["product_name"]

# ABC bounds (share of sales) and labels.
ABC_BOUNDS = (("0.80", "A"), ("0.95", "B"))
ABC_DEFAULT = "C"
# Pareto bound and group labels.
PARETO_BOUND = "0.80"
PARETO_TOP = "Top 80% Revenue Products"
PARETO_REST = "Remaining Products"


def top_products_by_sales(sl: DataFrame, n: int = 10, key: Sequence[str] = PRODUCT) -> DataFrame:
    return top_by(sl, key, M.money(M.sum_money("sales")), "total_sales", n)


def top_products_by_profit(sl: DataFrame, n: int = 10, key: Sequence[str] = PRODUCT) -> DataFrame:
    return top_by(sl, key, M.money(M.sum_money("profit")), "total_profit", n)


def loss_products(sl: DataFrame, n: int = 10, key: Sequence[str] = PRODUCT) -> DataFrame:
    """The ``n`` products with the most negative total profit."""
    return loss_groups(sl, key, with_sales=False, n=n)


def category_performance(sl: DataFrame) -> DataFrame:
    return performance_by(sl, "category")


def sub_category_performance(sl: DataFrame) -> DataFrame:
    return sales_by(sl, "sub_category")


def product_totals(sl: DataFrame, key: Sequence[str] = PRODUCT) -> DataFrame:
    return sl.groupBy(*key).agg(M.sum_money("sales").alias("total_sales"))


def product_sales_rank(sl: DataFrame, key: Sequence[str] = PRODUCT, **kw) -> DataFrame:
    """Every product with ``RANK() OVER (ORDER BY total_sales DESC)``."""
    ranked = O.rank(product_totals(sl, key), [O.desc("total_sales")], out="sales_rank", tie_break=key, **kw)
    return ranked.select(*key, M.money("total_sales").alias("total_sales"), "sales_rank")


def top_product_per_category(sl: DataFrame, group: str = "category",
                             key: Sequence[str] = PRODUCT_NAME) -> DataFrame:
    """The best-selling product of each category (ties: smallest name).

    ``row_number() = 1`` lets Catalyst insert a per-task group limit before
    the shuffle, so a category holding most products still moves one row
    per task.
    """
    totals = sl.groupBy(group, *key).agg(M.sum_money("sales").alias("_s"))
    w = Window.partitionBy(group).orderBy(F.col("_s").desc_nulls_first(),
                                          *[F.col(k).asc_nulls_last() for k in key])
    best = totals.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
    return best.select(group, *key, M.money("_s").alias("total_sales"))


def _mean_parts(totals: DataFrame, col: str) -> Column:
    """(sum, non-null count) of ``col`` as one scalar subquery (a struct)."""
    return totals.select(F.struct(F.sum(col).alias("g"), F.count(col).alias("n"))).scalar()


def at_or_above_mean(x: Column, parts: Column, strict: bool) -> Column:
    """``x > mean`` (or ``>=``) without dividing: ``x * n`` vs the sum."""
    lhs, rhs = x * parts.getField("n"), parts.getField("g")
    return lhs > rhs if strict else lhs >= rhs


def products_above_average(sl: DataFrame, key: Sequence[str] = PRODUCT_NAME) -> DataFrame:
    """Products whose total sales exceed the mean of all product totals."""
    totals = product_totals(sl, key)
    parts = _mean_parts(totals, "total_sales")
    return totals.where(at_or_above_mean(F.col("total_sales"), parts, strict=True)).select(
        *key, M.money("total_sales").alias("total_sales")
    ).orderBy(desc("total_sales"))


# ------------------------------------------------------------ ABC / Pareto


def _written_totals(sl: DataFrame, key: Sequence[str]) -> tuple[DataFrame, Column]:
    """Product totals, written once, and their sum as a scalar subquery
    over that small table (NULL totals add nothing)."""
    totals = materialize(product_totals(sl, key), "product-totals")
    return totals, totals.select(F.sum("total_sales")).scalar()


def _zero_total(overall: Column, strict: bool, value: Column, kind: str) -> Column:
    """``value``, or what a grand total of 0 gives: an error, as dividing by
    it does, or NULL."""
    if strict:
        zero = F.raise_error(F.lit("grand total is 0: cumulative share undefined")).cast(kind)
    else:
        zero = F.lit(None).cast(kind)
    return F.when(overall == 0, zero).otherwise(value)


def _classes(sl: DataFrame, key: Sequence[str], bounds, default: str, strict: bool, bins: int) -> tuple[DataFrame, Column]:
    """Written product totals, and the class of a row: a product belongs to
    the first bound whose share the sales down to its own total stay in.
    That is a comparison with one cut value per bound, found by counting."""
    totals = materialize(product_totals(sl, key), "product-totals")
    cuts, grand = S.share_cuts(totals, "total_sales", [share for share, _ in bounds], bins=bins)
    expr = F.when(F.lit(False), F.lit(default))
    for (_, label), cut in zip(bounds, cuts):
        if cut is not None:
            expr = expr.when(F.col("total_sales") >= F.lit(cut), F.lit(label))
    return totals, _zero_total(F.lit(grand), strict, expr.otherwise(F.lit(default)), "string")


def abc_summary(sl: DataFrame, key: Sequence[str] = PRODUCT_NAME, bounds=ABC_BOUNDS,
                default: str = ABC_DEFAULT, strict: bool = True, bins: int = S.BINS) -> DataFrame:
    """Products, sales per ABC class."""
    totals, label = _classes(sl, key, bounds, default, strict, bins)
    return totals.groupBy(label.alias("abc_category")).agg(
        F.count(F.lit(1)).cast("bigint").alias("products_count"),
        M.money(M.sum_money("total_sales")).alias("total_sales"),
    ).orderBy(asc("abc_category"))


def abc_classes(sl: DataFrame, key: Sequence[str] = PRODUCT_NAME, bounds=ABC_BOUNDS,
                default: str = ABC_DEFAULT, strict: bool = True, bins: int = S.BINS) -> DataFrame:
    """ABC class of every product."""
    totals, label = _classes(sl, key, bounds, default, strict, bins)
    return totals.select(*key, M.money("total_sales").alias("total_sales"), label.alias("abc_category"))


def pareto_table(sl: DataFrame, key: Sequence[str] = PRODUCT, strict: bool = True, **kw) -> DataFrame:
    """Every product with its cumulative share of sales, in percent."""
    totals, overall = _written_totals(sl, key)
    cum = O.cumulative_sum(totals, "total_sales", [O.desc("total_sales")], out="_cum", tie_break=key, **kw)
    pct = _zero_total(overall, strict, M.ratio(F.col("_cum"), overall, factor=100), "double")
    return cum.select(
        *key, M.money("total_sales").alias("total_sales"), pct.alias("cumulative_sales_pct"),
    ).orderBy(desc("total_sales"))


def pareto_80_count(sl: DataFrame, key: Sequence[str] = PRODUCT, bound: str = PARETO_BOUND,
                    strict: bool = True, bins: int = S.BINS) -> DataFrame:
    """How many products make up the first ``bound`` share of sales; without
    ``strict`` NULL when the grand total is 0."""
    totals, label = _classes(sl, key, ((bound, PARETO_TOP),), PARETO_REST, strict, bins)
    # A label is NULL only where the share is undefined (grand total 0).
    known = totals.select(label.alias("group"), "total_sales")
    undefined = F.count_if(F.col("group").isNull() & F.col("total_sales").isNotNull()) > 0
    return known.agg(F.when(~undefined, F.count_if(F.col("group") == PARETO_TOP)).cast("bigint").alias(
        "products_generating_80pct_sales"))


def pareto_groups(sl: DataFrame, key: Sequence[str] = PRODUCT, bound: str = PARETO_BOUND,
                  strict: bool = True, bins: int = S.BINS) -> DataFrame:
    totals, label = _classes(sl, key, ((bound, PARETO_TOP),), PARETO_REST, strict, bins)
    return totals.groupBy(label.alias("pareto_group")).agg(
        F.count(F.lit(1)).cast("bigint").alias("products_count"),
        M.money(M.sum_money("total_sales")).alias("total_sales"),
    )
