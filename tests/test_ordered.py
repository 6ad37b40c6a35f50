"""The distributed ordered scan equals the plain single-partition window."""

from __future__ import annotations

import random
from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storeflow.operators import ordered as O
from storeflow.operators import selection as S
from storeflow.plans.inspect import physical_plan
from storeflow.sources.storage import materialize

DDL = "id long, grp string, v decimal(12,2), f long"


def _df(spark, rows):
    return spark.createDataFrame(rows, DDL)


def _same(a, b, cols):
    return sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))


ROWS = [
    (1, "a", Decimal("5.00"), 3), (2, "a", Decimal("5.00"), 3), (3, "b", None, 1),
    (4, "b", Decimal("7.50"), 3), (5, "a", Decimal("1.00"), 2), (6, "c", None, None),
    (7, "c", Decimal("5.00"), 3), (8, "b", Decimal("-2.00"), 1), (9, "a", Decimal("7.50"), 2),
    (10, "c", Decimal("0.00"), 3), (11, "a", Decimal("5.00"), 1), (12, "b", Decimal("9.99"), 3),
]


def _check_all(spark, rows, rpb):
    df = _df(spark, rows)
    for prefix in ([], ["grp"]):
        order = [O.desc("v")]
        w = O.plain_window(order, prefix=prefix)
        assert _same(O.rank(df, order, prefix, out="r", rows_per_bucket=rpb),
                     df.withColumn("r", F.rank().over(w)), ["id", "r"])
        assert _same(O.cumulative_sum(df, "v", order, prefix, out="c", rows_per_bucket=rpb),
                     df.withColumn("c", F.sum("v").over(w)), ["id", "c"])
        order = [O.desc("f")]
        w = O.plain_window(order, ["id"], prefix)
        assert _same(O.ntile(df, 5, order, ["id"], prefix, out="t", rows_per_bucket=rpb),
                     df.withColumn("t", F.ntile(5).over(w)), ["id", "t"])
        assert _same(O.row_number(df, order, ["id"], prefix, out="n", rows_per_bucket=rpb),
                     df.withColumn("n", F.row_number().over(w)), ["id", "n"])
        order = [O.asc("v")]
        w = O.plain_window(order, prefix=prefix)
        assert _same(O.cumulative_sum(df, "v", order, prefix, out="c", rows_per_bucket=rpb),
                     df.withColumn("c", F.sum("v").over(w)), ["id", "c"])


def test_ties_nulls_prefixes_many_buckets(spark):
    _check_all(spark, ROWS, rpb=2)


def test_default_buckets(spark):
    _check_all(spark, ROWS, rpb=O.ROWS_PER_BUCKET)


def test_several_ntiles_by_counting(spark):
    df = materialize(_df(spark, ROWS))
    specs = [("a", 5, O.asc("v")), ("b", 3, O.desc("f")), ("c", 4, O.desc("v")), ("d", 2, O.asc("f")), ("e", 50, O.asc("v"))]
    want = df
    for name, k, sort in specs:
        want = want.withColumn(name, F.ntile(k).over(O.plain_window([sort], ["id"])))
    for bins in (2, S.BINS):
        got = S.ntiles(df, specs, ["id"], bins)
        assert _same(got, want, ["id", "a", "b", "c", "d", "e"])
    plan = physical_plan(got)
    assert "Exchange" not in plan and "Sort" not in plan and "Join" not in plan


KEYED = [(i, k, v) for i, (k, v) in enumerate([
    ("a", 5), ("", 5), (None, 5), ("a\x00", 5), ("ab", 5), ("Customer#000000001", 5), ("Customer#000000010", 5),
    ("Customer#000000002", None), ("é", 5), ("zz", None), ("customer#1", 7), ("\U0001f600", 5), ("b", -(1 << 40)), ("c", 1 << 40)])]


def test_ntiles_with_string_keys_and_one_hot_value(spark):
    """Ties are cut by the key's bytes; NULL keys come last."""
    df = materialize(spark.createDataFrame(KEYED, "i long, k string, v long"))
    for sort in (O.asc("v"), O.desc("v")):
        w = O.plain_window([sort], ["k"])
        for tiles in (3, 14):
            want = df.withColumn("t", F.ntile(tiles).over(w))
            assert _same(S.ntiles(df, [("t", tiles, sort)], ["k"], 64), want, ["i", "t"])


def test_ntiles_of_no_rows_and_of_other_types(spark):
    none = materialize(spark.createDataFrame([], "k long, v long"))
    assert S.ntiles(none, [("t", 5, O.asc("v"))], ["k"]).count() == 0
    days = materialize(spark.range(30).selectExpr("id AS k", "date_add(DATE'2020-01-01', CAST(id % 7 AS INT)) AS v"))
    want = days.withColumn("t", F.ntile(4).over(O.plain_window([O.desc("v")], ["k"])))
    assert _same(S.ntiles(days, [("t", 4, O.desc("v"))], ["k"]), want, ["k", "t"])
    with pytest.raises(TypeError):
        S.ntiles(materialize(spark.createDataFrame([("a", 1)], "v string, k long")), [("t", 2, O.asc("v"))], ["k"])


def test_one_value_in_half_of_all_rows(spark):
    """The peer group spans many buckets; ranks and sums come out whole and
    no plan joins on the sort value."""
    rows = [(i, "a" if i % 3 else "b", Decimal("1.00") if i % 2 else Decimal(i % 11), i) for i in range(400)]
    df = _df(spark, rows)
    for prefix in ([], ["grp"]):
        for order in ([O.desc("v")], [O.asc("v")]):
            w = O.plain_window(order, prefix=prefix)
            ranked = O.rank(df, order, prefix, out="r", rows_per_bucket=20)
            summed = O.cumulative_sum(df, "v", order, prefix, out="c", tie_break=["id"], rows_per_bucket=20)
            assert _same(ranked, df.withColumn("r", F.rank().over(w)), ["id", "r"])
            assert _same(summed, df.withColumn("c", F.sum("v").over(w)), ["id", "c"])
            for frame in (ranked, summed):
                keys = [x for x in physical_plan(frame).split("\n") if "keys" in x and ("Left" in x or "Right" in x)]
                assert keys and not any("v#" in k for k in keys), keys


def test_share_cuts_against_sorted_sums(spark):
    rng = random.Random(5)
    for trial in range(6):
        values = [None if rng.random() < 0.1 else Decimal(rng.choice([rng.randint(-500, 900), 100, 0, rng.randint(0, 10**9)])) / 100
                  for _ in range(rng.choice([1, 5, 40]))]
        if trial % 3 == 0:
            values = [v and -v for v in values]
        df = spark.createDataFrame([(v,) for v in values], "v decimal(18,2)")
        known = sorted((v for v in values if v is not None), reverse=True)
        total = sum(known)
        want = []
        for share in ("0.5", "0.80", "0.95"):
            inside = [v for v in set(known) if total and Fraction(sum(x for x in known if x >= v)) / Fraction(total) <= Fraction(share)]
            want.append(min(inside, default=None))
        for bins in (13, S.BINS):
            cuts, grand = S.share_cuts(df, "v", ("0.5", "0.80", "0.95"), bins=bins)
            assert cuts == want and grand == (total if known else None), (values, cuts, want)
    with pytest.raises(ValueError):
        S.share_cuts(df, "v", ["1.0"])


def test_hot_value_is_spread_over_buckets(spark):
    # A third of all rows share one value: the tie-break still splits them.
    rows = [(i, "a", Decimal("1.00"), 7 if i % 3 == 0 else i) for i in range(300)]
    df = _df(spark, rows)
    tagged = O.range_buckets(df, [F.col("f").desc_nulls_first(), F.col("id").asc_nulls_last()], 10)
    sizes = [r["count"] for r in tagged.groupBy("_b").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 100
    # buckets follow the order: every key of bucket b sorts before bucket b+1
    edges = tagged.groupBy("_b").agg(F.max("f").alias("hi"), F.min("f").alias("lo")).collect()
    edges = sorted(edges, key=lambda r: r["_b"])
    assert all(a["lo"] >= b["hi"] for a, b in zip(edges, edges[1:]))
    got = O.ntile(df, 5, [O.desc("f")], ["id"], out="t", rows_per_bucket=30)
    want = df.withColumn("t", F.ntile(5).over(O.plain_window([O.desc("f")], ["id"])))
    assert _same(got, want, ["id", "t"])


def test_ntile_sizes_differ_by_at_most_one(spark):
    rows = [(i, "a", Decimal(i % 7), i % 4) for i in range(23)]
    got = O.ntile(_df(spark, rows), 5, [O.desc("f")], ["id"], out="t", rows_per_bucket=4)
    sizes = sorted((r["t"], r["count"]) for r in got.groupBy("t").count().collect())
    counts = [c for _, c in sizes]
    assert [t for t, _ in sizes] == [1, 2, 3, 4, 5]
    assert counts == sorted(counts, reverse=True) and max(counts) - min(counts) <= 1


rows_st = st.lists(
    st.tuples(st.sampled_from(["a", "b"]),
              st.one_of(st.none(), st.integers(-300, 300).map(lambda x: Decimal(x) / 100)),
              st.one_of(st.none(), st.integers(0, 4))),
    min_size=1, max_size=25,
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows_st, st.integers(1, 6))
def test_property_equals_plain_window(spark, data, rpb):
    rows = [(i, g, v, f) for i, (g, v, f) in enumerate(data)]
    _check_all(spark, rows, rpb)
