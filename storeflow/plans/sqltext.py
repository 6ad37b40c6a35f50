"""SQL text shared by the oracle queries (DuckDB dialect).

The oracle reads the driver's raw tables, so every query starts from the
same order-line shaping as ``sources.tables.sales_lines``, written as a
CTE.  Rounded means and ratios are computed in integers (half away from
zero) because a DuckDB quotient of decimals is a double.
"""

from __future__ import annotations

SALES_SQL = (
    "CAST(ROUND(CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(0.005 AS DECIMAL(4,3)), 2)"
    " AS DECIMAL(12,2))"
)
DISCOUNT_SQL = "CAST(CAST(l.l_discount AS DECIMAL(4,2)) * 6 AS DECIMAL(4,2))"

JOINED = """
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey"""

SL_BASE = f"""sl_base AS (
  SELECT
    concat_ws('-', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR),
              CAST(l.l_partkey AS VARCHAR), CAST(l.l_suppkey AS VARCHAR),
              CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR)) AS row_id,
    concat_ws('-', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR)) AS line_key,
    o.o_orderkey AS order_id,
    CAST(o.o_orderdate AS DATE) AS order_date,
    CAST(l.l_shipdate AS DATE) AS ship_date,
    o.o_orderpriority AS ship_mode,
    c.c_custkey AS customer_id,
    c.c_name AS customer_name,
    c.c_mktsegment AS segment,
    'United States' AS country,
    'Springfield' AS city,
    n.n_name AS state,
    '10001' AS postal_code,
    r.r_name AS region,
    p.p_partkey AS product_id,
    p.p_type AS category,
    p.p_brand AS sub_category,
    p.p_name AS product_name,
    {SALES_SQL} AS sales,
    CAST(l.l_quantity AS INTEGER) AS quantity,
    {DISCOUNT_SQL} AS discount{JOINED}
)"""

SL = """sl AS (
  SELECT row_id, order_id, order_date, ship_date, ship_mode, customer_id, customer_name,
         segment, country, city, state, postal_code, region, product_id, category,
         sub_category, product_name, sales, quantity, discount,
         CAST(ROUND(sales * (CAST(0.30 AS DECIMAL(3,2)) - discount), 2) AS DECIMAL(12,2)) AS profit
  FROM sl_base
)"""


def with_sl(body: str, *ctes: str) -> str:
    """``WITH sl_base, sl[, more CTEs] <body>``."""
    parts = [SL_BASE, SL, *ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


def money(expr: str) -> str:
    return f"CAST(ROUND({expr}, 2) AS DECIMAL(18,2))"


def cnt(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def round_ratio(num: str, den: str, factor: int = 1) -> str:
    """``round(num / den * factor, 2)`` as DOUBLE, exact, half away from zero.

    ``num`` and ``den`` have at most two decimals.  With x = num in cents
    times 100 * factor and d = den in cents, the result is
    sign(x*d) * ((|x|*2 + |d|) // (2|d|)) / 100; NULL when d = 0 or NULL.
    """
    x = f"CAST(({num}) * 100 * {factor * 100} AS HUGEINT)"
    d = f"CAST(({den}) * 100 AS HUGEINT)"
    return (
        f"(CASE WHEN {d} = 0 THEN NULL ELSE "
        f"CAST(sign({x}) * sign({d}) * ((abs({x}) * 2 + abs({d})) // (2 * abs({d}))) AS DOUBLE) / 100"
        f" END)"
    )


def mean(col: str) -> str:
    return round_ratio(f"SUM({col})", f"COUNT({col})")
