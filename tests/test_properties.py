"""Invariants over the driver data (sf0.001)."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from storeflow.operators import aggregates as A
from storeflow.operators import customers as U
from storeflow.operators import products as P
from storeflow.operators import profitability as R
from storeflow.operators import timeseries as TS
from storeflow.sources.raw import bronze_lines
from storeflow.sources.silver import silver_lines
from storeflow.operators import clean as C
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def sl(spark):
    return silver_lines(spark, SF_SMALL)


@pytest.fixture(scope="module")
def overview(sl):
    return A.business_overview(sl).collect()[0]


BREAKDOWNS = {
    "category": lambda sl: A.sales_by(sl, "category"),
    "sub_category": lambda sl: A.sales_by(sl, "sub_category"),
    "region": lambda sl: A.performance_by(sl, "region"),
    "state": R.state_profitability,
    "ship_mode": A.ship_mode_summary,
    "discount_band": R.discount_bands,
    "discount": R.discount_impact,
    "year": TS.sales_by_year,
    "month": TS.sales_by_month,
    "segment": U.segment_performance,
}


@pytest.mark.parametrize("name", sorted(BREAKDOWNS))
def test_breakdowns_add_up_to_the_overview(sl, overview, name):
    rows = BREAKDOWNS[name](sl).collect()
    assert sum(r["total_sales"] for r in rows) == overview["total_sales"]
    assert sum(r["total_profit"] for r in rows) == overview["total_profit"]


def test_line_counts_add_up(sl):
    n = sl.count()
    assert sum(r["orders_count"] for r in R.discount_bands(sl).collect()) == n
    assert sum(r["orders_count"] for r in A.ship_mode_summary(sl).collect()) == n


def test_classes_and_segments_partition_their_entities(sl, overview):
    n_names = sl.select("product_name").distinct().count()
    assert sum(r["products_count"] for r in P.abc_summary(sl).collect()) == n_names
    assert sum(r["products_count"] for r in P.pareto_groups(sl).collect()) == overview["total_products"]
    n_cust = sl.select("customer_id", "customer_name").distinct().count()
    assert sum(r["customers_count"] for r in U.rfm_segment_summary(sl).collect()) == n_cust
    tiers = U.customer_value_tier(sl).groupBy("customer_segment").count().collect()
    assert sum(r["count"] for r in tiers) == n_cust
    assert P.pareto_80_count(sl).collect()[0][0] == next(
        r["products_count"] for r in P.pareto_groups(sl).collect()
        if r["pareto_group"] == "Top 80% Revenue Products")


def test_abc_share_of_class_a_is_at_most_80_percent(sl, overview):
    a = [r for r in P.abc_summary(sl).collect() if r["abc_category"] == "A"]
    assert not a or a[0]["total_sales"] * 100 <= overview["total_sales"] * 80


def test_pareto_share_is_monotone_and_ends_at_100(sl):
    rows = sorted(P.pareto_table(sl).collect(), key=lambda r: -r["total_sales"])
    pct = [r["cumulative_sales_pct"] for r in rows]
    assert all(a <= b for a, b in zip(pct, pct[1:]))
    assert pct[-1] == 100.0


def test_rank_is_one_plus_strictly_greater(sl):
    rows = U.customer_sales_rank(sl, rows_per_bucket=40).collect()
    totals = sorted((r["total_sales"] for r in rows), reverse=True)
    for r in rows[:200]:
        assert r["sales_rank"] == 1 + sum(1 for t in totals if t > r["total_sales"])


def test_rfm_tiles_are_balanced(sl):
    s = U.rfm_scores(sl, bins=40)
    for col in ("r_score", "f_score", "m_score"):
        counts = sorted(r["count"] for r in s.groupBy(col).count().collect())
        assert len(counts) == 5 and counts[-1] - counts[0] <= 1


def test_cleaning_keeps_every_row(spark):
    raw = bronze_lines(spark, SF_SMALL)
    assert len(C.clean(raw).select("row_id", "order_date").collect()) == raw.count()


def test_money_sum_is_exact(spark):
    df = spark.range(1000).select((F.lit(Decimal("0.01")) * F.col("id")).cast("decimal(12,2)").alias("x"))
    from storeflow.functions import money as M
    got = df.agg(M.sum_money("x").alias("s")).collect()[0]["s"]
    assert got == Decimal("4995.00")


def test_approximate_distinct_counts_are_close(sl):
    exact = A.business_overview(sl).collect()[0]
    approx = A.business_overview(sl, exact=False).collect()[0]
    for c in ("total_orders", "total_customers", "total_products"):
        assert abs(approx[c] - exact[c]) <= 0.05 * exact[c]
    assert approx["total_sales"] == exact["total_sales"]


def test_revenue_shares_add_up_to_100(sl):
    from decimal import Decimal as D
    rows = A.revenue_share(sl, "region").collect()
    assert abs(sum(D(str(r["share_pct"])) for r in rows) - 100) <= D("0.01") * len(rows)


def test_value_tier_thresholds_are_arguments(sl):
    tiers = [(">=", 20000, "Gold"), (">=", 1, "Silver")]
    got = {r["customer_segment"] for r in U.customer_value_tier(sl, tiers, "None").collect()}
    assert got <= {"Gold", "Silver", "None"} and "Silver" in got
