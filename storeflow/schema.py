"""Canonical shapes of the order-line tables.

One row is one order line.  ``RAW_TO_CLEAN`` is the renaming of the
cleaning step; ``CLEAN_TYPES`` the types the cleaning step produces.
Identifiers keep whatever type the source gives them (string or long):
no operator depends on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The raw column names of the source table and their
# snake_case names after cleaning, in source order.
RAW_TO_CLEAN = {
    "Row ID": "row_id",
    "Order ID": "order_id",
    "Order Date": "order_date",
    "Ship Date": "ship_date",
    "Ship Mode": "ship_mode",
    "Customer ID": "customer_id",
    "Customer Name": "customer_name",
    "Segment": "segment",
    "Country": "country",
    "City": "city",
    "State": "state",
    "Postal Code": "postal_code",
    "Region": "region",
    "Product ID": "product_id",
    "Category": "category",
    "Sub-Category": "sub_category",
    "Product Name": "product_name",
    "Sales": "sales",
    "Quantity": "quantity",
    "Discount": "discount",
    "Profit": "profit",
}

RAW_COLUMNS = list(RAW_TO_CLEAN)

# Types of the raw source: dates are text, money is floating point, the
# postal code is an integer (it loses leading zeros on load).
RAW_TYPES: dict[str, T.DataType] = {
    c: T.StringType() for c in RAW_COLUMNS
} | {
    "Row ID": T.StringType(),
    "Postal Code": T.IntegerType(),
    "Sales": T.DoubleType(),
    "Quantity": T.IntegerType(),
    "Discount": T.DoubleType(),
    "Profit": T.DoubleType(),
}
RAW_SCHEMA = T.StructType([T.StructField(c, RAW_TYPES[c], True) for c in RAW_COLUMNS])
CLEAN_COLUMNS = list(RAW_TO_CLEAN.values())

MONEY = T.DecimalType(12, 2)
RATE = T.DecimalType(4, 2)
# Result types shared with the SQL oracle: money totals, counts, ratios.
MONEY_OUT = "decimal(18,2)"
RATIO_OUT = "double"

# Types fixed by the cleaning step; the other columns keep their type.
CLEAN_TYPES: dict[str, T.DataType] = {
    "order_date": T.DateType(),
    "ship_date": T.DateType(),
    "postal_code": T.StringType(),
    "sales": MONEY,
    "quantity": T.IntegerType(),
    "discount": RATE,
    "profit": MONEY,
}

# Columns the null audit checks (the business-critical ones).
CRITICAL_RAW_COLUMNS = [
    "Order ID",
    "Order Date",
    "Customer ID",
    "Product ID",
    "Sales",
    "Quantity",
    "Profit",
]

POSTAL_CODE_MAX_LEN = 10


def check_clean(df: DataFrame) -> DataFrame:
    """Raise if ``df`` lacks a clean column or has a wrong fixed type."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in CLEAN_COLUMNS if c not in fields]
    if missing:
        raise ValueError(f"not a clean order-line table, missing {missing}")
    wrong = {
        c: fields[c].simpleString()
        for c, t in CLEAN_TYPES.items()
        if c != "postal_code" and fields[c] != t
    }
    if wrong:
        raise ValueError(f"clean columns with wrong types: {wrong}")
    return df
