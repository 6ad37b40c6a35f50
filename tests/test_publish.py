"""Results written as tables read back equal to the query."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from storeflow.operators import aggregates as A
from storeflow.operators.breakdowns import KEYS, breakdown, measures
from storeflow.plans import catalog
from storeflow.plans.inspect import physical_plan
from storeflow.plans.publish import publish
from storeflow.sources.silver import silver_lines
from storeflow.sources.storage import materialize
from tests.conftest import SF_SMALL, line


def test_published_tables_equal_queries(spark, tmp_path):
    out = str(tmp_path)
    keys = ["business_overview", "abc_summary", "rfm_segment_summary", "sales_by_month", "loss_states"]
    paths = publish(spark, SF_SMALL, out, keys)
    for key in keys:
        table = spark.read.parquet(paths[key])
        query = catalog.queries()[key](spark, SF_SMALL)
        assert [(f.name, f.dataType) for f in table.schema] == [(f.name, f.dataType) for f in query.schema]
        assert sorted(table.collect()) == sorted(query.collect())


def test_breakdowns_equal_the_single_queries(spark):
    table = materialize(measures(silver_lines(spark, SF_SMALL)), "measures")
    for key in KEYS:
        own, single = breakdown(table, key), catalog.queries()[key](spark, SF_SMALL)
        assert [(f.name, f.dataType) for f in own.schema] == [(f.name, f.dataType) for f in single.schema], key
        assert sorted(own.collect(), key=repr) == sorted(single.collect(), key=repr), key


def test_breakdowns_of_nulls_and_zero_sales(spark, lines):
    sl = lines([line(1, category=None, sales=None, profit=None), line(2, category="a", discount=None),
                line(3, category="a", sales="0.00", region="zero"), line(4, category="b", order_date=None, ship_date=None)])
    table = materialize(measures(sl), "measures")
    for key, single in (("sales_by_category", lambda sl: A.sales_by(sl, "category")), ("category_performance", lambda sl: A.performance_by(sl, "category")),
                        ("shipping_performance", A.shipping_performance), ("revenue_share", A.revenue_share)):
        assert sorted(breakdown(table, key).collect(), key=repr) == sorted(single(sl).collect(), key=repr), key
    # An unguarded margin of a region without sales raises, as the single query does.
    with pytest.raises(Exception, match="[Dd]ivi"):
        breakdown(table, "region_performance").collect()
    assert measures(sl.limit(0)).count() == 0


def test_one_scan_makes_all_measures(spark):
    plan = physical_plan(measures(silver_lines(spark, SF_SMALL)), "simple")
    assert plan.count("FileScan") == 1
    table = materialize(measures(silver_lines(spark, SF_SMALL)), "measures")
    for key in KEYS:
        scans = [x for x in physical_plan(breakdown(table, key), "simple").split("\n") if "FileScan" in x]
        assert scans and all("dimension" in x for x in scans)  # the written table's column
    assert table.where(F.col("dimension").isNull()).isEmpty()
