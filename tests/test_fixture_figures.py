"""Figures recorded independently for the sf0.01 order lines (FIXTURES.md)."""

from __future__ import annotations

from decimal import Decimal

from storeflow.operators import aggregates as A
from storeflow.operators import customers as U
from storeflow.operators import products as P
from storeflow.operators import profitability as R
from storeflow.sources.silver import silver_lines
from tests.conftest import SF_ORACLE


def _counts(df, col, n="count"):
    return {r[col]: r[n] for r in df.collect()}


def test_recorded_figures(spark):
    sl = silver_lines(spark, SF_ORACLE)
    o = A.business_overview(sl).collect()[0]
    assert (o["total_sales"], o["total_profit"]) == (Decimal("15916283.61"), Decimal("-2541.32"))
    assert _counts(R.discount_bands(sl), "discount_group", "orders_count") == {
        "No Discount": 2941, "Low Discount": 18060, "Medium Discount": 30160, "High Discount": 8839}
    assert _counts(U.customer_value_tier(sl).groupBy("customer_segment").count(), "customer_segment") == {
        "VIP": 798, "Regular": 612, "Low Value": 90}
    assert _counts(P.abc_summary(sl), "abc_category", "products_count") == {"A": 47, "B": 12, "C": 5}
    assert _counts(P.abc_summary(sl, key=P.PRODUCT), "abc_category", "products_count") == {
        "A": 1468, "B": 375, "C": 157}
    assert _counts(R.profitability_matrix(sl, key=P.PRODUCT).groupBy("profitability_segment").count(),
                   "profitability_segment") == {
        "High Sales / High Profit": 495, "High Sales / Low Profit": 471,
        "Low Sales / High Profit": 521, "Low Sales / Low Profit": 513}
    assert _counts(U.rfm_segment_summary(sl), "customer_segment", "customers_count") == {
        "Champions": 147, "Loyal Customers": 276, "Potential Loyalists": 177, "At Risk": 290,
        "Others": 610}
    assert A.loss_groups(sl, ["state"]).count() == 13
    assert R.loss_orders(sl).count() == 7352
    assert A.loss_groups(sl, P.PRODUCT).count() == 992
    assert R.high_discount_products(sl).count() == 33
