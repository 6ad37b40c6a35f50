"""Physical plan checks: what the plans must (not) contain."""

from __future__ import annotations

import glob
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from storeflow.operators import aggregates as A
from storeflow.operators import customers as U
from storeflow.operators import products as P
from storeflow.operators import quality as Q
from storeflow.plans.inspect import executed_plan, physical_plan, single_partition_inputs
from storeflow.session import ensure_checkpoint_dir
from storeflow.sources.silver import silver_lines
from storeflow.sources.storage import refresh
from tests.conftest import SF_SMALL


ORDERED = {
    "customer_sales_rank": U.customer_sales_rank, "product_sales_rank": P.product_sales_rank,
    "rfm_scores": U.rfm_scores, "rfm_segments": U.rfm_segments, "rfm_segment_summary": U.rfm_segment_summary,
    "rfm_segment_rank": U.rfm_segment_rank, "abc_summary": P.abc_summary, "abc_classes": P.abc_classes,
    "pareto_table": P.pareto_table, "pareto_80_count": P.pareto_80_count, "pareto_groups": P.pareto_groups,
}


# Found by counting: no join and no sort of entities at all.
COUNTED = {"rfm_scores", "rfm_segments", "rfm_segment_summary", "abc_summary", "abc_classes", "pareto_80_count", "pareto_groups"}


@pytest.mark.parametrize("key", sorted(ORDERED))
def test_ordered_scans_never_gather_entities(spark, key):
    """With default arguments, small tables included: no exchange into one
    partition carries customers or products, and several buckets exist."""
    sl = silver_lines(spark, SF_SMALL)
    plan = physical_plan(ORDERED[key](sl))
    entity = {"customer_id", "customer_name", "product_id", "product_name", "total_sales", "monetary", "_cum", "_rn"}
    assert "SortMergeJoin" not in plan or key not in COUNTED
    for cols in single_partition_inputs(plan):
        assert not entity & set(cols), (cols, plan)


def test_default_buckets_follow_the_parallelism(spark):
    df = spark.range(100)
    from storeflow.operators import ordered as O
    from storeflow.session import parallelism
    assert O.bucket_count(df, 100, O.ROWS_PER_BUCKET) == parallelism(spark)
    assert O.bucket_count(df, 10**12, O.ROWS_PER_BUCKET) == 10**6  # no cap


def test_same_call_writes_no_new_table(spark):
    sl = silver_lines(spark, SF_SMALL)
    U.rfm_scores(sl).collect()
    root = os.path.join(ensure_checkpoint_dir(spark), "storeflow")
    before = {d for d, _, _ in os.walk(root)}
    U.rfm_scores(sl).collect()
    assert {d for d, _, _ in os.walk(root)} == before


def test_refresh_removes_and_rebuilds(spark):
    sl = silver_lines(spark, SF_SMALL)
    n = sl.count()
    P.abc_summary(sl).collect()
    refresh(spark)
    root = os.path.join(ensure_checkpoint_dir(spark), "storeflow")
    assert not [f for d, _, fs in os.walk(root) if "/llm/" not in d for f in fs if f.endswith(".parquet")]
    again = silver_lines(spark, SF_SMALL)
    assert again is not sl and again.count() == n


def test_top_k_is_take_ordered(spark):
    sl = silver_lines(spark, SF_SMALL)
    assert "TakeOrderedAndProject" in physical_plan(U.top_customers_by_sales(sl))
    assert "TakeOrderedAndProject" in physical_plan(P.loss_products(sl))


def test_filters_and_columns_reach_the_scan(spark):
    sl = silver_lines(spark, SF_SMALL)
    plan = physical_plan(Q.loss_lines(sl).select("row_id"))
    assert "PushedFilters: [IsNotNull(profit), LessThan(profit,0.00)]" in plan
    plan = physical_plan(A.sales_by(sl, "category"))
    assert "ReadSchema: struct<category:string,sales:decimal(12,2),profit:decimal(12,2)>" in plan


def test_best_per_category_limits_before_shuffle(spark):
    sl = silver_lines(spark, SF_SMALL)
    assert "WindowGroupLimit" in physical_plan(P.top_product_per_category(sl))


def test_no_python_udfs_anywhere(spark):
    sl = silver_lines(spark, SF_SMALL)
    for df in (U.rfm_segments(sl, bins=50), P.pareto_table(sl, rows_per_bucket=50),
               A.business_overview(sl)):
        plan = physical_plan(df)
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def shuffled_bytes(folder, begin: int, end: int) -> int:
    """Shuffle bytes written by tasks that began in a span of milliseconds
    (event log)."""
    total = 0
    for path in glob.glob(os.path.join(folder, "*")):
        with open(path) as f:
            for line in f:
                if '"SparkListenerTaskEnd"' in line:
                    event = json.loads(line)
                    if not begin <= event["Task Info"]["Launch Time"] <= end:
                        continue
                    metrics = event.get("Task Metrics") or {}
                    total += metrics.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
    return total


DUPLICATES_SCRIPT = """
import sys, time
from pyspark.sql import functions as F
from storeflow.operators.quality import full_duplicate_count
from storeflow.session import local_session
log, scratch = sys.argv[1:]
spark = local_session(4, extra={
    "spark.eventLog.enabled": "true", "spark.eventLog.dir": log, "spark.eventLog.compress": "false",
    "spark.eventLog.rolling.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "10"}, checkpoint_dir=scratch)
for share in (0, 1, 90):
    ids = spark.range(60000).select(F.when(F.col("id") % 100 < share, F.col("id") % 1000).otherwise(F.col("id")).alias("id"))
    path = f"{scratch}/rows{share}"
    ids.select(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 256).alias(f"c{k}") for k in range(6)]) \\
        .write.parquet(path)
    rows = spark.read.parquet(path)
    for how in ("plain", "hashed"):
        begin = time.time()
        if how == "plain":
            n = rows.groupBy(*rows.columns).count().agg(F.sum(F.col("count") - 1)).collect()[0][0]
        else:
            n = full_duplicate_count(rows).collect()[0][0]
        print("RUN", share, how, n, int(begin * 1000), int(time.time() * 1000))
spark.stop()
"""


def test_duplicate_check_shuffles_the_same_whatever_repeats(tmp_path):
    """At the shape of large tables (nothing is broadcast) the bytes per row
    do not follow the share of repeated rows, and stay far below those of
    grouping whole rows."""
    log, scratch = tmp_path / "log", tmp_path / "scratch"
    log.mkdir()
    scratch.mkdir()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run(
        [sys.executable, "-c", DUPLICATES_SCRIPT, f"file://{log}", str(scratch)],
        cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    runs = [line.split()[1:] for line in run.stdout.splitlines() if line.startswith("RUN")]
    moved, found = {}, {}
    for share, how, n, begin, end in runs:
        moved[share, how] = shuffled_bytes(str(log), int(begin), int(end))
        found[share, how] = int(n)
    for share in ("0", "1", "90"):
        assert found[share, "plain"] == found[share, "hashed"]
    assert found["0", "hashed"] == 0 < found["1", "hashed"] < found["90", "hashed"]
    assert moved["1", "hashed"] <= 1.02 * moved["0", "hashed"] and moved["90", "hashed"] <= moved["0", "hashed"], moved
    assert moved["0", "hashed"] < 0.25 * moved["0", "plain"], moved


@pytest.mark.parametrize("bits", [0, 3])
def test_duplicate_check_is_exact_under_a_short_hash(spark, bits):
    """With few hash values nearly all groups disagree and rows are compared
    in full; NULLs that swap columns and values that print unlike count
    right."""
    rows = [(None, "x", 1.0), ("x", None, 1.0), ("x", None, 1.0), ("1", "2", 0.0), ("1", "2", -0.0), ("12", "", 0.0),
            ("1", "2", None), (None, None, None), (None, None, None), ("a", "b", float("nan")), ("a", "b", float("nan"))]
    df = spark.createDataFrame(rows * 2 + [("only", "once", 2.0)], "a string, b string, c double")
    want = sum(r["count"] - 1 for r in df.groupBy("a", "b", "c").count().collect())

    def short(cols):
        return Q.row_hash(cols).bitwiseAND(F.lit((1 << bits) - 1))

    assert Q.full_duplicate_count(df, hash_of=short).first()[0] == want
    assert Q.full_duplicate_count(df).first()[0] == want


def test_executed_plan_is_final(spark):
    sl = silver_lines(spark, SF_SMALL)
    plan = executed_plan(A.sales_by(sl, "category"))
    assert "isFinalPlan=true" in plan and "isFinalPlan=false" not in plan
