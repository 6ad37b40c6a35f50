"""Every registered query equals its DuckDB oracle on the driver tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as E
from storeflow.operators import customers as U
from storeflow.operators import products as P
from storeflow.sources.silver import silver_lines
from tests.conftest import SF_ORACLE, SF_SMALL
from tests.oracle_harness import compare, duck

SF = os.environ.get("STOREFLOW_TEST_SF", SF_SMALL)
KEYS = sorted(E.catalog.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_key_has_oracle_sql():
    assert set(KEYS) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    res = compare(df, E.oracle_sql()[key], con)
    assert res["ok"], res


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert [f.name for f in df.schema.fields] == [
        "customer_segment", "customers_count", "total_sales", "avg_customer_sales"]
    assert sum(r["customers_count"] for r in rows) > 0


DISTRIBUTED = {
    "customer_sales_rank": lambda sl: U.customer_sales_rank(sl, rows_per_bucket=97),
    "rfm_scores": lambda sl: U.rfm_scores(sl, bins=5),
    "rfm_segment_summary": lambda sl: U.rfm_segment_summary(sl, bins=5),
    "rfm_segment_rank": lambda sl: U.rfm_segment_rank(sl, rows_per_bucket=97),
    "product_sales_rank": lambda sl: P.product_sales_rank(sl, rows_per_bucket=97),
    "abc_summary": lambda sl: P.abc_summary(sl, bins=3),
    "abc_classes": lambda sl: P.abc_classes(sl, bins=3),
    "pareto_table": lambda sl: P.pareto_table(sl, rows_per_bucket=97),
    "pareto_groups": lambda sl: P.pareto_groups(sl, bins=16),
}


FIND_SOMETHING = ["invalid_dates", "negative_sales", "bad_quantity", "duplicate_keys", "bad_ship_dates"]


@pytest.mark.parametrize("key", FIND_SOMETHING)
def test_checks_find_defects(spark, key):
    assert E.queries()[key](spark, SF).limit(1).count() == 1


def test_audit_counts_are_not_zero(spark):
    audit = E.queries()["null_audit"](spark, SF).collect()[0].asDict()
    assert audit["order_date_nulls"] == 0 and audit["profit_nulls"] > 0 and audit["customer_id_nulls"] > 0
    assert E.queries()["full_duplicate_count"](spark, SF).collect()[0]["duplicate_rows"] > 0
    summary = {r["check"]: r["violations"] for r in E.queries()["quality_summary"](spark, SF).collect()}
    assert all(summary.values()), summary


@pytest.mark.parametrize("key", sorted(DISTRIBUTED))
def test_distributed_path_matches_oracle(spark, key):
    """The many-bucket path of the ordered scan on real data (sf0.01:
    1,500 customers and 2,000 products in ~16-20 buckets)."""
    sf = SF_ORACLE
    df = DISTRIBUTED[key](silver_lines(spark, sf))
    res = compare(df, E.oracle_sql()[key], duck(sf))
    assert res["ok"], res
