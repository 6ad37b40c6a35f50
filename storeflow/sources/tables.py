"""Reading the driver's star-schema tables and shaping them into order lines.

``sales_lines`` joins ``lineitem`` with its order, customer, nation,
region and part into the clean order-line shape (one row per line).  The
money factors are fixed so that every threshold of the analyses is
reached on this data.  ``sources.raw`` gives those lines the source's raw
shape, and ``sources.silver`` cleans them: the table that analyses read.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed values of the adapter: money factors and the constant location
# columns that only the cleaning step reads.
SALES_FACTOR = "0.005"
DISCOUNT_FACTOR = 6
MARGIN = "0.30"
COUNTRY = "United States"
CITY = "Springfield"
POSTAL_CODE = 10001


# The tables that an order line is made of.
LINE_TABLES = ("lineitem", "orders", "customer", "nation", "region", "part")


def line_sources(sf_dir: str) -> list[str]:
    return [os.path.join(sf_dir, f"{name}.parquet") for name in LINE_TABLES]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _sales(extended_price: Column) -> Column:
    price = extended_price.cast("decimal(12,2)")
    return F.round(price * F.lit(SALES_FACTOR).cast("decimal(4,3)"), 2).cast("decimal(12,2)")


def _discount(raw_discount: Column) -> Column:
    return (raw_discount.cast("decimal(4,2)") * F.lit(DISCOUNT_FACTOR)).cast("decimal(4,2)")


def _profit(sales: Column, discount: Column) -> Column:
    rate = F.lit(MARGIN).cast("decimal(3,2)") - discount
    return F.round(sales * rate, 2).cast("decimal(12,2)")


def joined_lines(spark: SparkSession, sf_dir: str, of_orders: Sequence[Column] = ()) -> DataFrame:
    """Line items with order, customer, geography and part attributes, and
    the columns ``of_orders``, worked out once per order, not per line.

    All joins are left to the planner and AQE: the files' sizes decide what
    is broadcast, the large ones are shuffled on their keys.  Lines meet
    their parts first and their orders last, so that a large table's lines
    lie by order: what groups them by order, or holds their ids, moves and
    writes less.  Nation and region come after that; no shuffle carries
    their names.
    """
    t = lambda name: read_table(spark, sf_dir, name)
    lines = t("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_quantity", "l_extendedprice", "l_discount", "l_shipdate",
    )
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", *of_orders)
    customers = t("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nations = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    regions = t("region").select("r_regionkey", "r_name")
    parts = t("part").select("p_partkey", "p_name", "p_brand", "p_type")

    geo = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        geo, F.col("c_nationkey") == F.col("n_nationkey")
    )


def row_id(*parts: Column) -> Column:
    return F.concat_ws("-", *[p.cast("string") for p in parts])
