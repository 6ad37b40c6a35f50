"""Raw-shaped order lines (the input of the cleaning step) built from the
driver tables.

The source's shape: the 21 display names, dates as ``MM/dd/yyyy`` text,
money as double, postal code as integer, and text defects that the cleaning
step must repair:

* customer names of every 250th customer key carry U+FFFD where the
  clean name has ``#``;
* product names of every 10th part key have each space replaced by two
  U+FFFD and a space added at both ends.

``Row ID`` is unique (order, line, part, supplier, ship date).  The name
corrections for this data are derived by Spark from the raw lines and the
customer table.

``audit_lines`` is a second raw table for the checks that must find
something: the same lines with defects at fixed order keys.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import REPLACEMENT_CHAR
from ..schema import RAW_TO_CLEAN
from .storage import named_table
from .tables import (
    CITY, COUNTRY, POSTAL_CODE, _discount, _profit, _sales, joined_lines, line_sources, read_table, row_id,
)

# Fixed values of the defect injection (fixture shaping, not filtering).
CUSTOMER_DEFECT_EVERY = 250
PRODUCT_DEFECT_EVERY = 10
# Order keys with remainder r of AUDIT_EVERY carry the defect of r.
AUDIT_EVERY = 97
BAD_DATE, NO_PROFIT, NEGATIVE_SALES, NO_QUANTITY, REPEATED, NO_CUSTOMER = 1, 2, 3, 4, 5, 6
BAD_DATE_TEXT = "not a date"


def folder_tag(sf_dir: str) -> str:
    return hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:12]


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_date = lambda c: F.date_format(F.col(c).cast("date"), "MM/dd/yyyy")
    j = joined_lines(spark, sf_dir, [text_date("o_orderdate").alias("order_date_text")])
    sales = _sales(F.col("l_extendedprice"))
    discount = _discount(F.col("l_discount"))
    fffd = F.lit(REPLACEMENT_CHAR)
    cname = F.when(
        F.col("c_custkey") % CUSTOMER_DEFECT_EVERY == 0, F.replace(F.col("c_name"), F.lit("#"), fffd)
    ).otherwise(F.col("c_name"))
    pname = F.when(
        F.col("p_partkey") % PRODUCT_DEFECT_EVERY == 0,
        F.concat(F.lit(" "), F.replace(F.col("p_name"), F.lit(" "), F.lit(REPLACEMENT_CHAR * 2)),
                 F.lit(" ")),
    ).otherwise(F.col("p_name"))
    cols = {
        "Row ID": row_id(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"),
                         F.col("l_suppkey"), F.col("l_shipdate").cast("date")),
        "Order ID": F.col("o_orderkey"),
        "Order Date": F.col("order_date_text"),
        "Ship Date": text_date("l_shipdate"),
        "Ship Mode": F.col("o_orderpriority"),
        "Customer ID": F.col("c_custkey"),
        "Customer Name": cname,
        "Segment": F.col("c_mktsegment"),
        "Country": F.lit(COUNTRY),
        "City": F.lit(CITY),
        "State": F.col("n_name"),
        "Postal Code": F.lit(POSTAL_CODE),
        "Region": F.col("r_name"),
        "Product ID": F.col("p_partkey"),
        "Category": F.col("p_type"),
        "Sub-Category": F.col("p_brand"),
        "Product Name": pname,
        "Sales": sales.cast("double"),
        "Quantity": F.col("l_quantity").cast("int"),
        "Discount": discount.cast("double"),
        "Profit": _profit(sales, discount).cast("double"),
    }
    assert list(cols) == list(RAW_TO_CLEAN)
    return j.select(*[expr.alias(name) for name, expr in cols.items()])


def bronze_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_lines`` written once per application and folder (the raw
    snapshot every cleaning query reads)."""
    return named_table(spark, f"bronze/raw_lines-{folder_tag(sf_dir)}", lambda: raw_lines(spark, sf_dir),
                       sources=line_sources(sf_dir))


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze with defects: ``Row ID`` is (order, line), which repeats, and
    the order keys' remainders give unparseable dates, missing profits and
    customers, negative sales, zero quantities and rows that repeat.
    A projection of the written bronze table in one scan: a copy of its own
    would cost more to write than it saves its readers."""
    return with_defects(bronze_lines(spark, sf_dir))


def with_defects(raw: DataFrame) -> DataFrame:
    kind = F.col("Order ID") % AUDIT_EVERY
    changed = {
        "Row ID": F.substring_index("Row ID", "-", 2),
        "Order Date": F.when(kind == BAD_DATE, F.lit(BAD_DATE_TEXT)).otherwise(F.col("Order Date")),
        "Profit": F.when(kind != NO_PROFIT, F.col("Profit")),
        "Sales": F.when(kind == NEGATIVE_SALES, -F.col("Sales")).otherwise(F.col("Sales")),
        "Quantity": F.when(kind == NO_QUANTITY, 0).otherwise(F.col("Quantity")),
        "Customer ID": F.when(kind != NO_CUSTOMER, F.col("Customer ID")),
    }
    twice = F.when(kind == REPEATED, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return raw.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in raw.columns], F.explode(twice).alias("_copy")).drop("_copy")


def name_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(wrong, right) pairs: every raw customer name holding U+FFFD next
    to the customer table's spelling for the same customer key.  Written
    once with bronze, so the planner knows its size."""
    def build() -> DataFrame:
        raw = bronze_lines(spark, sf_dir)
        bad = (raw.where(F.col("Customer Name").contains(REPLACEMENT_CHAR))
               .select(F.col("Customer ID").alias("_id"), F.col("Customer Name").alias("wrong"))
               .distinct())
        cust = read_table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("_id"), F.col("c_name").alias("right"))
        return bad.join(cust, "_id").select("wrong", "right").distinct()

    return named_table(spark, f"bronze/corrections-{folder_tag(sf_dir)}", build, sources=line_sources(sf_dir))
