"""Customer figures kept current over loads by mergeable partial states.

A state has one row per customer and order: the last order date and the
sales, in cents.  States of two loads merge by adding rows up again (an
order whose lines came in two loads is still one order), so the state after
any split into loads is that of all lines, and a load costs its own lines
plus a merge with rows that are already as few as the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money as M
from .customers import CUSTOMER

ORDER = [*CUSTOMER, "order_id"]


def customer_state(sl: DataFrame) -> DataFrame:
    """The state of clean order lines (NULL sales add nothing; an order
    without any sales has NULL)."""
    return sl.groupBy(*ORDER).agg(
        F.max("order_date").alias("last_order_date"), M.sum_money("sales").alias("sales"))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all lines behind ``states``."""
    every = states[0]
    for state in states[1:]:
        every = every.unionByName(state)
    return every.groupBy(*ORDER).agg(
        F.max("last_order_date").alias("last_order_date"), M.sum_money("sales").alias("sales"))


def rfm_base_of(state: DataFrame) -> DataFrame:
    """``customers.rfm_base`` from a state: no distinct count is left to do,
    as every order of a customer is one row (orders without an id aside)."""
    last_date = state.select(F.max("last_order_date")).scalar()
    return state.groupBy(*CUSTOMER).agg(
        F.max("last_order_date").alias("last_order_date"),
        F.datediff(last_date, F.max("last_order_date")).cast("bigint").alias("recency_days"),
        F.count("order_id").cast("bigint").alias("frequency"),
        M.sum_money("sales").alias("monetary"))
