"""Cleaning and validation on hand-made raw lines."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from storeflow.functions.text import repair_text
from storeflow.operators import clean as C
from storeflow.operators import quality as Q
from storeflow.plans.inspect import physical_plan
from storeflow.schema import RAW_COLUMNS, check_clean
from storeflow.sources.raw import with_defects

FFFD = "�"
RAW_DDL = ", ".join(
    f"`{c}` {t}" for c, t in zip(RAW_COLUMNS, [
        "string", "string", "string", "string", "string", "string", "string", "string",
        "string", "string", "string", "int", "string", "string", "string", "string", "string",
        "double", "int", "double", "double"]))


def raw_row(i, **kw):
    r = {"Row ID": str(i), "Order ID": f"O{i}", "Order Date": "1/5/2016", "Ship Date": "11/08/2016",
         "Ship Mode": "Standard", "Customer ID": f"C{i}", "Customer Name": "Anna", "Segment": "S",
         "Country": "US", "City": "X", "State": "NY", "Postal Code": 501, "Region": "East",
         "Product ID": f"P{i}", "Category": "Cat", "Sub-Category": "Sub", "Product Name": "Desk",
         "Sales": 10.005, "Quantity": 2, "Discount": 0.2, "Profit": -1.115}
    r.update(kw)
    return tuple(r[c] for c in RAW_COLUMNS)


@pytest.fixture
def raw(spark):
    return lambda rows: spark.createDataFrame(rows, RAW_DDL)


def test_clean_types_dates_money_text(raw):
    rows = [
        raw_row(1, **{"Product Name": f"  Big{FFFD}{FFFD}Desk\t Pro  ", "Customer Name": f"Peter B{FFFD}hler"}),
        raw_row(2, **{"Order Date": "13/40/2016", "Ship Date": "", "Sales": 2.5}),
        raw_row(3, **{"Order Date": None, "Customer Name": "Peter Bühler"}),
    ]
    out = check_clean(C.clean(raw(rows), strict_dates=False))
    got = {r["row_id"]: r.asDict() for r in out.collect()}
    assert got["1"]["order_date"] == dt.date(2016, 1, 5)
    assert got["1"]["ship_date"] == dt.date(2016, 11, 8)
    assert got["1"]["product_name"] == "Big Desk Pro"
    assert got["1"]["customer_name"] == "Peter Bühler" == got["3"]["customer_name"]
    assert got["1"]["postal_code"] == "501"  # no padding by default
    assert got["1"]["sales"] == Decimal("10.01") and got["1"]["profit"] == Decimal("-1.12")
    assert got["2"]["order_date"] is None and got["2"]["ship_date"] is None
    padded = C.clean(raw(rows[:1]), pad_postal_code=5).collect()[0]
    assert padded["postal_code"] == "00501"


def test_quality_summary_and_invalid_dates(raw):
    rows = [raw_row(1), raw_row(1),  # a full duplicate
            raw_row(2, **{"Order Date": "12/31/2016", "Ship Date": "1/1/2016"}),
            raw_row(3, **{"Sales": -1.0, "Quantity": 0}),
            raw_row(4, **{"Order Date": "bad"}),
            raw_row(5, **{"Profit": None, "Customer ID": None})]
    df = raw(rows)
    got = {r["check"]: r["violations"] for r in Q.quality_summary(df).collect()}
    assert got == {"rows": 6, "missing_values": 1, "duplicate_rows": 1, "invalid_dates": 1,
                   "shipped_before_ordered": 1, "negative_sales": 1, "invalid_quantity": 1}
    assert Q.invalid_dates(df).count() == 1
    nulls = Q.null_audit(df).collect()[0].asDict()
    assert nulls["profit_nulls"] == 1 and nulls["customer_id_nulls"] == 1 and nulls["sales_nulls"] == 0


def test_full_duplicates_treat_nulls_as_equal(raw):
    rows = [raw_row(1, Profit=None), raw_row(1, Profit=None), raw_row(1, Profit=None), raw_row(2)]
    assert Q.full_duplicate_count(raw(rows)).collect()[0]["duplicate_rows"] == 2


def test_keys(raw):
    df = C.rename(raw([raw_row(1), raw_row(1, Sales=3.0), raw_row(2)]))
    dups = Q.duplicate_keys(df).collect()
    assert [(r["row_id"], r["duplicate_count"]) for r in dups] == [("1", 2)]
    with pytest.raises(ValueError):
        Q.assert_key(df)
    Q.assert_key(C.rename(raw([raw_row(1), raw_row(2)])))
    with pytest.raises(ValueError):
        Q.assert_key(C.rename(raw([raw_row(1, **{"Row ID": None})])))


def test_corrupt_name_report_and_unicode_spaces(raw, spark):
    rows = [raw_row(1, **{"Customer Name": f"Anna H{FFFD}berlin"}),
            raw_row(2, **{"Customer Name": f"Anna H{FFFD}berlin"}),
            raw_row(3, **{"Customer Name": f"Roy Franz{FFFD}sisch"})]
    rep = Q.corrupt_name_report(C.rename(raw(rows))).collect()
    assert [(r["customer_name"], r["records_count"]) for r in rep] == [
        (f"Anna H{FFFD}berlin", 2), (f"Roy Franz{FFFD}sisch", 1)]
    nbsp = raw([raw_row(1, **{"Product Name": "A  B"})])
    assert C.clean(nbsp).collect()[0]["product_name"] == "A  B"
    assert C.clean(nbsp, unicode_spaces=True).collect()[0]["product_name"] == "A B"


def test_schema_report(raw):
    rep = {r["column_name"]: r["data_type"] for r in Q.schema_report(raw([raw_row(1)])).collect()}
    assert rep["Postal Code"] == "int" and rep["Sales"] == "double" and len(rep) == 21


def test_conflicting_corrections_raise_repeated_ones_do_not_duplicate(raw, spark):
    rows = [raw_row(1, **{"Customer Name": f"Jo{FFFD}l"}), raw_row(2)]
    clash = C.corrections_frame(spark, [(f"Jo{FFFD}l", "Joël"), (f"Jo{FFFD}l", "Joel")])
    with pytest.raises(Exception, match="two replacements"):
        C.clean(raw(rows), clash).collect()
    same = C.corrections_frame(spark, [(f"Jo{FFFD}l", "Joël")] * 2)
    out = C.clean(raw(rows), same).collect()
    assert sorted(r["customer_name"] for r in out) == ["Anna", "Joël"]


def test_unparseable_dates_raise(raw):
    assert len(C.clean(raw([raw_row(1)])).collect()) == 1
    bad = raw([raw_row(1), raw_row(2, **{"Order Date": "13/40/2016"})])
    with pytest.raises(Exception, match="unparseable date"):
        C.clean(bad).collect()
    assert C.clean(bad, strict_dates=False).where("order_date IS NULL").count() == 1


def test_long_postal_codes_raise(raw):
    df = raw([raw_row(1)]).withColumn("Postal Code", F.lit("12345-678901"))
    with pytest.raises(Exception, match="postal code too long"):
        C.clean(df).collect()


def test_analyses_see_a_broken_cleaning_step(spark, monkeypatch):
    """The clean table is the cleaning step's output: a step that loses
    lines or breaks the key shows in what reads it."""
    from storeflow.plans import catalog
    from storeflow.sources import silver
    from storeflow.sources.storage import refresh
    from tests.conftest import SF_SMALL

    from storeflow.sources.load_checks import LoadRefused

    refresh(spark)
    whole = C.clean
    monkeypatch.setattr(silver, "clean", lambda *a, **k: whole(*a, **k).where("quantity > 10"))
    with pytest.raises(LoadRefused, match="raw rows became"):
        catalog.queries()["row_count_clean"](spark, SF_SMALL)
    monkeypatch.setattr(silver, "clean", lambda *a, **k: whole(*a, **k).withColumn("sales", F.lit(1).cast("decimal(12,2)")))
    broken = catalog.queries()["value_ranges"](spark, SF_SMALL).first()
    assert broken["max_sales"] == 1
    refresh(spark)
    monkeypatch.setattr(silver, "clean", lambda *a, **k: whole(*a, **k).withColumn("row_id", F.lit("1")))
    with pytest.raises(ValueError, match="primary key"):
        catalog.queries()["row_count_clean"](spark, SF_SMALL)
    monkeypatch.undo()
    refresh(spark)


def test_a_key_is_cleared_by_one_shuffle_of_hashes(raw, spark, monkeypatch):
    counted = []
    monkeypatch.setattr(Q, "duplicate_keys", lambda *a: counted.append(a))
    Q.assert_key(C.rename(raw([raw_row(1), raw_row(2)])))
    Q.assert_key(spark.range(1000).selectExpr("id % 10 AS a", "id DIV 10 AS b"), ["a", "b"])
    assert not counted


def test_hashes_that_meet_are_told_apart_by_their_keys(spark, monkeypatch):
    monkeypatch.setattr(Q.F, "xxhash64", lambda *key: F.lit(1))  # all collide
    Q.assert_key(spark.range(10), ["id"])
    with pytest.raises(ValueError, match="nulls=False duplicates=True"):
        Q.assert_key(spark.range(10).unionByName(spark.range(3)), ["id"])


@pytest.mark.parametrize("space", [" ", "\t", "\n", "\v", "\f", "\r"])
def test_every_run_of_spaces_is_one_space(spark, space):
    texts = [f"{space}a{space}b", f"a{space}{space}b{space}", "a b", FFFD + "a" + FFFD + FFFD + "b", f"a{FFFD}{space}b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0] for r in df.select(repair_text(F.col("t"))).collect()} == {"a b"}


def test_audit_lines_come_from_one_scan_with_their_repeats(raw, tmp_path, spark):
    raw([raw_row(i, **{"Order ID": str(i), "Customer ID": "c"}) for i in (1, 5, 96, 102)]
        + [raw_row(7, **{"Order ID": None})]).write.parquet(str(tmp_path / "raw"))
    audit = with_defects(spark.read.parquet(str(tmp_path / "raw")))
    assert sorted(str(r["Order ID"]) for r in audit.collect()) == ["1", "102", "102", "5", "5", "96", "None"]
    assert physical_plan(audit, "simple").count("FileScan parquet") == 1
