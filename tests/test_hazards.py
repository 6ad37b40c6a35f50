"""Hand-made tables for the semantic hazards (exact decimals, bounds,
nulls, zero totals, ties, orientation)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from storeflow.operators import aggregates as A
from storeflow.operators import customers as U
from storeflow.operators import products as P
from storeflow.operators import profitability as R
from tests.conftest import line


def _rows(df):
    return [r.asDict() for r in df.collect()]


def test_abc_bound_is_exact(lines):
    # share of the first product is 0.8000004: just above 80 % -> B, not A
    rows = [line(1, product_name="big", sales="8000004.00"),
            line(2, product_name="small", sales="1999996.00")]
    got = {r["abc_category"]: r["products_count"] for r in _rows(P.abc_summary(lines(rows)))}
    assert got == {"B": 1, "C": 1}


def test_abc_ties_at_the_bound_share_the_class(lines):
    rows = [line(i, product_name=f"p{i}", sales=s) for i, s in
            enumerate(["40.00", "40.00", "15.00", "5.00"])]
    got = {r["product_name"]: r["abc_category"] for r in _rows(P.abc_classes(lines(rows)))}
    assert got == {"p0": "A", "p1": "A", "p2": "B", "p3": "C"}


def test_first_item_above_80_leaves_a_empty(lines):
    rows = [line(1, product_name="x", sales="90.00"), line(2, product_name="y", sales="10.00")]
    got = {r["abc_category"] for r in _rows(P.abc_summary(lines(rows)))}
    assert got == {"B", "C"}


def test_null_totals_fall_to_c_and_zero_total_is_null(lines):
    rows = [line(1, product_name="n", sales=None), line(2, product_name="a", sales="10.00")]
    got = {r["product_name"]: r["abc_category"] for r in _rows(P.abc_classes(lines(rows)))}
    assert got == {"n": "C", "a": "C"}  # a alone is 100 % > 95 %
    zero = [line(1, product_name="z", sales="0.00")]
    assert [r["abc_category"] for r in _rows(P.abc_classes(lines(zero), strict=False))] == [None]


def test_negative_grand_total_keeps_the_quotient(lines):
    # cumulative shares of 10, -50, -60 in a total of -100: -0.1, 0.4, 1.0
    rows = [line(i, product_name=f"p{i}", product_id=f"P{i}", sales=s) for i, s in enumerate(["10.00", "-50.00", "-60.00"])]
    got = {r["product_name"]: r["abc_category"] for r in _rows(P.abc_classes(lines(rows)))}
    assert got == {"p0": "A", "p1": "A", "p2": "C"}
    assert _rows(P.pareto_80_count(lines(rows))) == [{"products_generating_80pct_sales": 2}]
    summary = {r["abc_category"]: r["products_count"] for r in _rows(P.abc_summary(lines(rows)))}
    assert summary == {"A": 2, "C": 1}
    groups = {r["pareto_group"]: r["products_count"] for r in _rows(P.pareto_groups(lines(rows)))}
    assert groups == {P.PARETO_TOP: 2, P.PARETO_REST: 1}
    shares = {r["product_name"]: r["cumulative_sales_pct"] for r in _rows(P.pareto_table(lines(rows)))}
    assert shares == {"p0": -10.0, "p1": 40.0, "p2": 100.0}


@pytest.mark.parametrize("query", [P.abc_summary, P.abc_classes, P.pareto_table, P.pareto_80_count, P.pareto_groups])
def test_zero_grand_total_raises_or_is_null(lines, query):
    rows = [line(1, product_name="a", product_id="a", sales="5.00"), line(2, product_name="b", product_id="b", sales="-5.00")]
    with pytest.raises(Exception, match="grand total is 0"):
        query(lines(rows)).collect()
    got = _rows(query(lines(rows), strict=False))
    undefined = {"abc_category", "cumulative_sales_pct", "products_generating_80pct_sales", "pareto_group"}
    assert got and all(r[c] is None for r in got for c in undefined & set(r))


def test_average_order_value_without_orders(lines):
    rows = [line(1, order_id=None, sales="5.00")]
    with pytest.raises(ArithmeticException):
        A.average_order_value(lines(rows)).collect()
    assert _rows(A.average_order_value(lines(rows), strict=False)) == [{"average_order_value": None}]


def test_money_sums_are_right_or_raise(spark):
    doubles = spark.createDataFrame([(0.29,), (1.15,), (None,)], "x double")
    assert doubles.agg(A.M.sum_money("x").alias("s")).collect()[0]["s"] == Decimal("1.44")
    places = spark.createDataFrame([(Decimal("0.2949"),), (Decimal("1.1549"),)], "x decimal(12,4)")
    with pytest.raises(Exception, match="decimal places"):
        places.agg(A.M.sum_money("x")).collect()
    assert places.agg(A.M.sum_money("x", scale=4).alias("s")).collect()[0]["s"] == Decimal("1.4498")


def test_mean_rounds_once_half_away_from_zero(lines):
    # profits 1.00 and 1.01 -> mean 1.005 -> 1.01; -0.28/-0.29 -> -0.285 -> -0.29
    rows = [line(1, discount="0.10", profit="1.00"), line(2, discount="0.10", profit="1.01"),
            line(3, discount="0.20", profit="-0.28"), line(4, discount="0.20", profit="-0.29")]
    got = {r["discount"]: r["avg_profit"] for r in _rows(R.discount_impact(lines(rows)))}
    assert got == {Decimal("0.10"): 1.01, Decimal("0.20"): -0.29}


def test_avg_of_many_uses_exact_sum(lines):
    # 2,009,999.99 over 2,000,000 -> 1.004999995 -> 1.00 (avg at 6 places would say 1.01)
    rows = [line(1, profit="2009999.99")] + [line(i, profit=None) for i in range(2, 4)]
    got = A.summarize(lines(rows), [], [A.M.mean("profit").alias("m")]).collect()[0]["m"]
    assert got == 2009999.99  # NULLs are skipped
    spark = lines(rows).sparkSession
    big = spark.range(2_000_000).select(
        F.when(F.col("id") == 0, F.lit(Decimal("1.00")) + F.lit(Decimal("9999.99")))
        .otherwise(F.lit(Decimal("1.00"))).cast("decimal(12,2)").alias("profit"))
    m = big.agg(A.M.mean("profit").alias("m")).collect()[0]["m"]
    assert m == 1.0


def test_null_discount_is_high_band_and_null_sales_low_tier(lines):
    rows = [line(1, discount=None), line(2, discount="0.00"), line(3, discount="0.20"),
            line(4, discount="0.50"), line(5, discount="0.60")]
    got = {r["discount_group"]: r["orders_count"] for r in _rows(R.discount_bands(lines(rows)))}
    assert got == {"High Discount": 2, "No Discount": 1, "Low Discount": 1, "Medium Discount": 1}
    tiers = _rows(U.customer_value_tier(lines([line(1, sales=None), line(2, sales="10000.00"),
                                               line(3, sales="5000.00")])))
    assert {r["customer_id"]: r["customer_segment"] for r in tiers} == {
        "C1": "Low Value", "C2": "VIP", "C3": "Regular"}


def test_zero_sales_region_strict_raises_guarded_is_null(lines):
    rows = [line(1, region="Z", sales="0.00", profit="0.00"), line(2, region="E")]
    with pytest.raises(ArithmeticException):
        A.region_performance(lines(rows)).collect()
    got = {r["region"]: r["profit_margin_pct"] for r in _rows(A.region_performance(lines(rows), strict=False))}
    assert got == {"Z": None, "E": 10.0}
    assert {r["region"]: r["profit_margin_pct"] for r in _rows(R.region_profitability(lines(rows)))}["Z"] is None


def test_two_spellings_split_a_customer(lines):
    rows = [line(1, customer_id="C1", customer_name="Anna"), line(2, customer_id="C1", customer_name="Ana")]
    assert len(_rows(U.customer_lifetime_value(lines(rows)))) == 2


def test_rfm_orientation(lines):
    d = dt.date(2020, 1, 1)
    rows = [line(i, customer_id=f"C{i}", order_date=d + dt.timedelta(days=i), sales=str(10 * i))
            for i in range(1, 11)]
    as_written = {r["customer_id"]: r["r_score"] for r in _rows(U.rfm_scores(lines(rows)))}
    flipped = {r["customer_id"]: r["r_score"] for r in
               _rows(U.rfm_scores(lines(rows), orientation="high_is_best"))}
    assert as_written["C10"] == 1 and flipped["C10"] == 5  # C10 ordered last = most recent
    assert all(as_written[k] + flipped[k] == 6 for k in as_written)


def test_rfm_few_customers(lines):
    rows = [line(i, customer_id=f"C{i}", order_id="O1") for i in range(3)]
    got = _rows(U.rfm_scores(lines(rows)))
    assert sorted(r["f_score"] for r in got) == [1, 2, 3]


def test_top_k_ties_are_broken_by_key(lines):
    rows = [line(i, state=s, sales="5.00") for i, s in enumerate("DCBAE")]
    got = [r["state"] for r in A.top_by(lines(rows), ["state"], A.M.money(F.sum("sales")),
                                       "total_sales", n=2).collect()]
    assert got == ["A", "B"]


def test_profitability_matrix_uses_exact_means(lines):
    rows = [line(1, product_name="a", sales="1.00", profit="1.00"),
            line(2, product_name="b", sales="2.00", profit="2.00"),
            line(3, product_name="c", sales="1.50", profit=None)]
    got = {r["product_name"]: r["profitability_segment"] for r in _rows(R.profitability_matrix(lines(rows)))}
    # mean sales 1.50 (c is exactly at the mean -> High), mean profit 1.50 over a, b
    assert got == {"a": "Low Sales / Low Profit", "b": "High Sales / High Profit",
                   "c": "Low Sales / Low Profit"}


def test_yoy_growth_skips_gaps(lines):
    rows = [line(1, order_date=dt.date(2018, 5, 1), sales="10.00"),
            line(2, order_date=dt.date(2020, 5, 1), sales="25.00")]
    from storeflow.operators.timeseries import yoy_growth
    got = {r["year"]: r["growth"] for r in _rows(yoy_growth(lines(rows)))}
    assert got == {2018: None, 2020: Decimal("15.00")}


def test_empty_table(lines, spark):
    empty = spark.createDataFrame([], lines([line(1)]).schema)
    assert _rows(A.business_overview(empty))[0]["total_orders"] == 0
    assert _rows(P.abc_summary(empty)) == []
    assert _rows(U.rfm_segment_summary(empty)) == []


def test_null_totals_sort_first_descending(lines):
    # PostgreSQL order: NULLs first for DESC, last for ASC
    rows = [line(1, state="A", sales="5.00", profit="1.00"),
            line(2, state="N", sales=None, profit=None),
            line(3, state="B", sales="9.00", profit="-1.00")]
    top = [r["state"] for r in A.top_by(lines(rows), ["state"], A.M.money(F.sum("sales")),
                                      "total_sales", n=3).collect()]
    assert top == ["N", "B", "A"]
    worst = [r["state"] for r in A.loss_groups(lines(rows), ["state"]).collect()]
    assert worst == ["B"]  # NULL profit is not < 0
    ranked = {r["customer_id"]: r["sales_rank"] for r in U.customer_sales_rank(lines(rows)).collect()}
    assert ranked == {"C2": 1, "C3": 2, "C1": 3}
