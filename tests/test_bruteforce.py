"""Operators against brute-force Python on random small tables."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storeflow.functions import money as M
from storeflow.operators import products as P
from tests.conftest import line

cents = st.integers(-100_000, 100_000).map(lambda c: Decimal(c) / 100)


def _round2(x: Decimal) -> float:
    return float(x.quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), cents), min_size=1, max_size=30),
       st.lists(cents, min_size=1, max_size=30))
def test_mean_and_margin_equal_exact_decimal(spark, values, sales):
    df = spark.createDataFrame([(v,) for v in values], "x decimal(12,2)")
    got = df.agg(M.mean("x").alias("m")).collect()[0]["m"]
    present = [v for v in values if v is not None]
    want = _round2(sum(present) / len(present)) if present else None
    assert got == want
    pairs = list(zip(sales, reversed(sales)))
    df2 = spark.createDataFrame(pairs, "s decimal(12,2), p decimal(12,2)")
    got2 = df2.agg(M.margin_pct(M.sum_money("p"), M.sum_money("s")).alias("m")).collect()[0]["m"]
    total_s, total_p = sum(s for s, _ in pairs), sum(p for _, p in pairs)
    want2 = None if total_s == 0 else _round2(total_p / total_s * 100)
    assert got2 == want2


def _abc_brute(totals: dict[str, Decimal | None]) -> dict[str, str | None]:
    present = [v for v in totals.values() if v is not None]
    overall = sum(present) if present else None  # SUM of no values is NULL
    out = {}
    for name, v in totals.items():
        if overall is None or v is None:
            # NULL share (NULL / NULL, or a NULL running sum): CASE's ELSE
            out[name] = None if overall == 0 else "C"
            continue
        cum = sum(w for w in totals.values() if w is not None and w >= v)  # peers included
        if overall == 0:
            out[name] = None
            continue
        share = Fraction(cum) / Fraction(overall)
        out[name] = "A" if share <= Fraction(80, 100) else "B" if share <= Fraction(95, 100) else "C"
    return out


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"),
                          st.one_of(st.none(), st.integers(-2000, 5000).map(lambda c: Decimal(c) / 100))),
                min_size=1, max_size=24),
       st.sampled_from([10**6, 2]))
def test_abc_classes_equal_brute_force(spark, lines_in, rpb):
    rows = [line(i, product_name=name, sales=s) for i, (name, s) in enumerate(lines_in)]
    from tests.conftest import CLEAN_DDL
    cols = [c.split()[0] for c in CLEAN_DDL.split(", ")]
    df = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], CLEAN_DDL)
    totals: dict[str, Decimal | None] = {}
    for name, s in lines_in:
        if s is not None:
            totals[name] = (totals.get(name) or Decimal(0)) + s
        else:
            totals.setdefault(name, None)
    want = _abc_brute(totals)
    got = {r["product_name"]: r["abc_category"]
           for r in P.abc_classes(df, bins=rpb, strict=False).collect()}
    assert got == want
    assert df.select(F.count("*")).collect()[0][0] == len(lines_in)
