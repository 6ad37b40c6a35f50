"""Loads: checked before they are published, noticed when a source changes,
added up file by file."""

from __future__ import annotations

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from storeflow.operators import customers as U
from storeflow.operators.clean import clean
from storeflow.operators.customer_state import customer_state, merge_states, rfm_base_of
from storeflow.plans.inspect import physical_plan
from storeflow.schema import CRITICAL_RAW_COLUMNS
from storeflow.sources import silver
from storeflow.sources.files import read_raw, write_raw_csv
from storeflow.sources.key_index import KeyIndex
from storeflow.sources.load_checks import Load, LoadRefused
from storeflow.sources.raw import audit_lines, bronze_lines, raw_lines
from storeflow.sources.silver import silver_lines, silver_version
from storeflow.sources.snapshot import Snapshot
from storeflow.sources.storage import materialize, named_table, named_version
from tests.conftest import SF_SMALL


@pytest.fixture
def own_tables(tmp_path):
    """A copy of the small tables that a test may change."""
    folder = tmp_path / "sf"
    shutil.copytree(SF_SMALL, folder)
    for f in folder.iterdir():
        os.chmod(f, 0o644)
    return str(folder)


def rewrite(spark, path: str, df) -> None:
    """Replace a Parquet file by the rows of ``df`` (one file)."""
    df.coalesce(1).write.parquet(path + ".new")
    part = next(f for f in os.listdir(path + ".new") if f.endswith(".parquet"))
    os.replace(os.path.join(path + ".new", part), path)


def test_a_changed_source_is_noticed(spark, own_tables):
    first = silver_lines(spark, own_tables)
    n = first.count()
    totals = materialize(U.customer_totals(first), "totals")
    written = totals.inputFiles()[0].removeprefix("file://")
    assert silver_lines(spark, own_tables) is first and os.path.exists(written)
    lines = os.path.join(own_tables, "lineitem.parquet")
    rewrite(spark, lines, spark.read.parquet(lines).where("l_linenumber = 1"))
    again = silver_lines(spark, own_tables)
    assert 0 < again.count() < n and again is not first
    assert not os.path.exists(written)  # written from the replaced version
    assert silver_lines(spark, own_tables) is again


def test_a_refused_load_leaves_the_table_in_place(spark, own_tables, monkeypatch):
    good = silver_version(spark, own_tables)
    assert good.facts["raw_rows"] == good.facts["clean_rows"] == good.table.count()
    lines = os.path.join(own_tables, "lineitem.parquet")
    rewrite(spark, lines, spark.read.parquet(lines).where("l_linenumber <= 2"))
    whole = clean
    monkeypatch.setattr(silver, "clean", lambda *a, **k: whole(*a, **k).where("quantity > 10"))
    with pytest.raises(LoadRefused, match="raw rows became"):
        silver_lines(spark, own_tables)
    assert os.listdir(os.path.dirname(good.path)) == [os.path.basename(good.path)]
    assert good.table.count() == good.facts["clean_rows"]
    monkeypatch.undo()
    with pytest.raises(LoadRefused, match="loss_lines"):
        silver_version(spark, own_tables, {"loss_lines": 0})
    assert silver_version(spark, own_tables, {"loss_lines": 10**9}).facts["clean_rows"] < good.facts["clean_rows"]


def test_figures_need_no_pass_of_their_own(spark, monkeypatch):
    """A load within its limits is never counted again."""
    raw = bronze_lines(spark, SF_SMALL)
    load = Load(raw, {"negative_sales": 0})
    load.raw = None  # counting again would need it

    def build():
        load.raw = raw
        observed = load.observed()
        load.raw = None
        return load.written(clean(observed))

    facts = named_version(spark, "silver/observed-test", build, load.check).facts
    want = clean(raw).agg(
        F.count("*"), F.count_if(F.col("profit") < 0), F.count_if(F.col("ship_date") < F.col("order_date"))).first()
    assert (facts["clean_rows"], facts["loss_lines"], facts["shipped_before_ordered"]) == tuple(want)


def test_a_figure_that_breaks_a_rule_is_counted_again(spark, monkeypatch):
    raw = bronze_lines(spark, SF_SMALL)
    load = Load(raw, {"negative_sales": 0})
    table = materialize(clean(raw), "recount-test")
    # As after a map stage that ran twice: too high, but the table is right.
    monkeypatch.setattr(load, "figures", lambda: {
        "raw_rows": 2 * raw.count(), "clean_rows": raw.count(), "negative_sales": 0})
    assert load.check(table)["raw_rows"] == raw.count()
    with pytest.raises(ValueError, match="no such figures"):
        Load(raw, {"nothing": 0})


def test_clean_lines_are_written_unobserved_and_counted_in_columns(spark, own_tables, monkeypatch):
    """An observation sees every column of every row; the figures need few."""
    plans, named = [], silver.named_version

    def seen(spark, name, build, *rest):
        return named(spark, name, lambda: plans.append(physical_plan(build(), "simple")) or build(), *rest)

    monkeypatch.setattr(silver, "named_version", seen)
    facts, table = (v := silver.audit_version(spark, own_tables)).facts, v.table
    assert len(plans) == 1 and "CollectMetrics" not in plans[0] and "FileScan" in plans[0]
    raw = audit_lines(spark, own_tables)
    assert facts["raw_rows"] == raw.count() == facts["clean_rows"] == table.count()
    missing = " or ".join(f"`{c}` is null" for c in CRITICAL_RAW_COLUMNS)
    rules = {"missing_values": (raw, missing), "shipped_before_ordered": (table, "ship_date < order_date"),
             "negative_sales": (table, "sales < 0"), "invalid_quantity": (table, "quantity <= 0"),
             "loss_lines": (table, "profit < 0"), "missing_dates": (table, "order_date is null or ship_date is null")}
    assert facts == {"raw_rows": raw.count(), "clean_rows": table.count(),
                     **{name: df.where(rule).count() for name, (df, rule) in rules.items()}}
    assert all(facts.values())


def test_order_dates_become_text_per_order(spark):
    above_the_joins = physical_plan(raw_lines(spark, SF_SMALL), "simple").split("Join")[0]
    assert "l_shipdate" in above_the_joins and "o_orderdate" not in above_the_joins


def test_named_tables_without_sources_stay(spark):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert named_table(spark, "plain-test", build) is named_table(spark, "plain-test", build) and len(calls) == 1


# ------------------------------------------------------------------ snapshots


@pytest.fixture
def raw_files(spark, tmp_path):
    """Raw CSV files by remainder of the order, in a folder of their own."""
    raw = bronze_lines(spark, SF_SMALL)
    folder = tmp_path / "raw"
    folder.mkdir()

    def put(k: int, name: str | None = None, where: str = "true") -> str:
        staged = str(tmp_path / f"staged-{k}-{time.time_ns()}")
        write_raw_csv(raw.where(F.col("Order ID") % 5 == k).where(where).coalesce(1), staged)
        part = next(f for f in os.listdir(staged) if f.endswith(".csv"))
        target = str(folder / (name or f"day {k}.csv"))
        os.replace(os.path.join(staged, part), target)
        return target

    return folder, put, raw


def same_lines(a, b) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_only_new_files_are_read(spark, tmp_path, raw_files):
    folder, put, raw = raw_files
    read = []

    def reader(spark, paths):
        read.append(sorted(os.path.basename(p) for p in paths))
        return read_raw(spark, paths)

    snap = Snapshot(spark, str(folder), str(tmp_path / "snap"), read=reader, buckets=4)
    assert snap.load().number == 0
    with pytest.raises(ValueError):
        snap.lines()
    put(0), put(1)
    first = snap.load()
    assert read == [["day 0.csv", "day 1.csv"]] and first.files_read == 2
    assert snap.load() == first and len(read) == 1  # nothing new: nothing read
    put(2)
    second = snap.load()
    assert read[1:] == [["day 2.csv"]] and second.parts[0] == first.parts[0]
    want = clean(raw.where(F.col("Order ID") % 5 <= 2).withColumn("Order ID", F.col("Order ID").cast("string"))
                 .withColumn("Customer ID", F.col("Customer ID").cast("string"))
                 .withColumn("Product ID", F.col("Product ID").cast("string")))
    assert same_lines(snap.lines(), want.select(*snap.lines().columns))
    # A reader of the version before still sees it.
    assert snap.lines(first).count() == raw.where(F.col("Order ID") % 5 <= 1).count()


def test_changed_and_removed_files(spark, tmp_path, raw_files):
    folder, put, raw = raw_files
    snap = Snapshot(spark, str(folder), str(tmp_path / "snap"), buckets=4)
    put(0), put(1)
    snap.load()
    changed = put(0, where="Quantity > 10")
    put(3)
    version = snap.load()
    assert version.files_read == 2
    kept = raw.where("(`Order ID` % 5 = 0 and Quantity > 10) or `Order ID` % 5 in (1, 3)").count()
    assert snap.lines().count() == kept
    os.remove(changed)
    assert snap.load().files_read == 0
    assert snap.lines().count() == raw.where("`Order ID` % 5 in (1, 3)").count()
    assert snap.load().number == 3
    # Another session object, same folder: the published state is found.
    assert Snapshot(spark, str(folder), str(tmp_path / "snap"), buckets=4).load().number == 3


def test_repeated_keys_within_and_across_loads_are_refused(spark, tmp_path, raw_files):
    folder, put, raw = raw_files
    snap = Snapshot(spark, str(folder), str(tmp_path / "snap"), buckets=4)
    put(0)
    first = snap.load()
    again = put(0, name="again.csv", where="Quantity > 40")
    with pytest.raises(LoadRefused, match="row_id"):
        snap.load()
    assert snap.current() == first and len(os.listdir(tmp_path / "snap" / "parts")) == 1
    os.remove(again)
    shutil.copy(put(1), str(folder / "copy.csv"))
    with pytest.raises(LoadRefused, match="row_id"):
        snap.load()
    os.remove(str(folder / "copy.csv"))
    # The refused loads' keys do not count.
    assert snap.load().number == 2


def test_two_loads_cannot_publish_one_version(spark, tmp_path, raw_files):
    folder, put, _ = raw_files
    snap = Snapshot(spark, str(folder), str(tmp_path / "snap"), key=None)
    put(0)
    version = snap.load()
    with pytest.raises(Exception, match="exist"):
        snap._publish(version)


def test_index_side_has_no_exchange(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "keys"), "index_plan_test", "bigint", 4)
    index.add(spark.range(1000).withColumnRenamed("id", "key"), "a")
    index.add(spark.range(1000, 1500).withColumnRenamed("id", "key"), "b")
    load = spark.createDataFrame([(7,), (1200,), (2000,), (2000,), (None,), (3000,)], "key bigint")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = index.repeated(load, ["a", "b"])
        plan = physical_plan(found, "simple")
        assert sorted((r["key"], r["times"], r["held"]) for r in found.collect() if r["key"] is not None) == [
            (7, 1, True), (1200, 1, True), (2000, 2, False)]
        assert {r["key"] for r in index.repeated(load, ["a"]).collect()} == {7, 2000, None}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "Bucketed: true" in plan
    # One exchange in all, that of the load's keys (a plan lists the left side first).
    above = plan.split("FileScan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and above.count("Exchange hashpartitioning") == 1, plan
    assert "Exchange" not in above.split("Sort [_held")[1], plan


# -------------------------------------------------------------------- states


@pytest.mark.parametrize("split", ["order_id % 3", "row_id < '3'", "quantity % 2"])
def test_states_merge_to_that_of_all_lines(spark, split):
    sl = silver_lines(spark, SF_SMALL)
    loads = [r[0] for r in sl.select(F.expr(split)).distinct().collect()]
    state = None
    for value in loads:
        new = customer_state(sl.where(F.expr(split) == F.lit(value)))
        state = materialize(new if state is None else merge_states(state, new), "customer-state")
    assert same_lines(rfm_base_of(state), U.rfm_base(sl))
