"""Named queries: each key maps to a Spark builder ``(spark, sf_dir) ->
DataFrame`` and, where SQL can express it, the same query as DuckDB SQL
over the driver's raw tables (the correctness oracle).

The analyses read the clean order lines (``silver_lines``: the cleaning
step's output, written once per application); the cleaning queries read the
raw-shaped lines (``bronze_lines``), and the checks for defects a copy with
defects at fixed keys (``audit_lines``).  Keys follow the inventory of the
source scripts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money as M
from ..operators import aggregates as A
from ..operators import clean as C
from ..operators import customers as U
from ..operators import products as P
from ..operators import profitability as R
from ..operators import quality as Qy
from ..operators import timeseries as TS
from ..sources.raw import audit_lines, bronze_lines, name_corrections
from ..sources.silver import audit_clean_lines, load_figures, silver_lines
from .loads import clean_lines_by_loads, rfm_metrics_by_loads
from .sqltext import cnt, mean, money, round_ratio, with_sl

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def _on_sl(fn) -> Builder:
    return lambda spark, sf: fn(silver_lines(spark, sf))


def _on_raw(fn) -> Builder:
    return lambda spark, sf: fn(bronze_lines(spark, sf))


def _on_audit(fn) -> Builder:
    return lambda spark, sf: fn(audit_lines(spark, sf))


def reg(name: str, builder: Builder, sql: str | None) -> None:
    REGISTRY[name] = (builder, sql)


SALES = money("SUM(sales)")
PROFIT = money("SUM(profit)")
MARGIN = round_ratio("SUM(profit)", "SUM(sales)", 100)
CUST = "customer_id, customer_name"
PROD = "product_id, product_name"

# ----------------------------------------------------------- raw-shaped lines

RAW_CTE = """raw AS (
  SELECT row_id AS "Row ID", line_key, order_id AS "Order ID",
         strftime(order_date, '%m/%d/%Y') AS "Order Date",
         strftime(ship_date, '%m/%d/%Y') AS "Ship Date",
         ship_mode AS "Ship Mode", customer_id AS "Customer ID",
         CASE WHEN customer_id % 250 = 0 THEN replace(customer_name, '#', '�')
              ELSE customer_name END AS "Customer Name",
         segment AS "Segment", country AS "Country", city AS "City", state AS "State",
         10001 AS "Postal Code", region AS "Region", product_id AS "Product ID",
         category AS "Category", sub_category AS "Sub-Category",
         CASE WHEN product_id % 10 = 0
              THEN ' ' || replace(product_name, ' ', '��') || ' '
              ELSE product_name END AS "Product Name",
         CAST(sales AS DOUBLE) AS "Sales", quantity AS "Quantity",
         CAST(discount AS DOUBLE) AS "Discount", CAST(profit AS DOUBLE) AS "Profit"
  FROM sl_full
)"""
# Fixed values, as in sources.raw: the defect of each remainder of 97.
AUDIT_CTE = """audit_one AS (
  SELECT line_key AS "Row ID", "Order ID",
         CASE WHEN "Order ID" % 97 = 1 THEN 'not a date' ELSE "Order Date" END AS "Order Date",
         "Ship Date", "Ship Mode", CASE WHEN "Order ID" % 97 <> 6 THEN "Customer ID" END AS "Customer ID",
         "Customer Name", "Segment", "Country", "City", "State", "Postal Code", "Region", "Product ID",
         "Category", "Sub-Category", "Product Name",
         CASE WHEN "Order ID" % 97 = 3 THEN -"Sales" ELSE "Sales" END AS "Sales",
         CASE WHEN "Order ID" % 97 = 4 THEN 0 ELSE "Quantity" END AS "Quantity", "Discount",
         CASE WHEN "Order ID" % 97 <> 2 THEN "Profit" END AS "Profit"
  FROM raw
), audit AS (
  SELECT * FROM audit_one UNION ALL SELECT * FROM audit_one WHERE "Order ID" % 97 = 5
)"""
AUDIT_CLEAN = """audit_clean_one AS (
  SELECT line_key AS row_id, order_id, CASE WHEN order_id % 97 <> 1 THEN order_date END AS order_date,
         ship_date, ship_mode, CASE WHEN order_id % 97 <> 6 THEN customer_id END AS customer_id,
         customer_name, segment, country, city, state, postal_code, region, product_id, category,
         sub_category, product_name,
         CAST(CASE WHEN order_id % 97 = 3 THEN -sales ELSE sales END AS DECIMAL(12,2)) AS sales,
         CAST(CASE WHEN order_id % 97 = 4 THEN 0 ELSE quantity END AS INTEGER) AS quantity, discount,
         CASE WHEN order_id % 97 <> 2 THEN profit END AS profit
  FROM sl_full
), audit_clean AS (
  SELECT * FROM audit_clean_one UNION ALL SELECT * FROM audit_clean_one WHERE order_id % 97 = 5
)"""
SL_FULL = """sl_full AS (
  SELECT b.*, CAST(ROUND(sales * (CAST(0.30 AS DECIMAL(3,2)) - discount), 2) AS DECIMAL(12,2)) AS profit
  FROM sl_base b
)"""
RAW_COLS = ('"Row ID", "Order ID", "Order Date", "Ship Date", "Ship Mode", "Customer ID", '
            '"Customer Name", "Segment", "Country", "City", "State", "Postal Code", "Region", '
            '"Product ID", "Category", "Sub-Category", "Product Name", "Sales", "Quantity", '
            '"Discount", "Profit"')


def with_raw(body: str) -> str:
    return with_sl(body, SL_FULL, RAW_CTE)


def with_audit(body: str) -> str:
    return with_sl(body, SL_FULL, RAW_CTE, AUDIT_CTE)


def _parse(col: str) -> str:
    return f"CAST(try_strptime({col}, '%m/%d/%Y') AS DATE)"


_OD, _SD = _parse('"Order Date"'), _parse('"Ship Date"')
_BAD_DATE = (f'("Order Date" IS NOT NULL AND {_OD} IS NULL) OR '
             f'("Ship Date" IS NOT NULL AND {_SD} IS NULL)')


reg("raw_snapshot", _on_raw(lambda raw: raw), with_raw(f"SELECT {RAW_COLS} FROM raw"))
reg("row_count_raw", _on_raw(Qy.row_count), with_raw("SELECT CAST(COUNT(*) AS BIGINT) AS total_rows FROM raw"))
reg("null_audit", _on_audit(Qy.null_audit), with_audit(
    "SELECT " + ", ".join(
        f'CAST(SUM(CASE WHEN "{c}" IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS {a}_nulls'
        for c, a in [("Order ID", "order_id"), ("Order Date", "order_date"),
                     ("Customer ID", "customer_id"), ("Product ID", "product_id"),
                     ("Sales", "sales"), ("Quantity", "quantity"), ("Profit", "profit")])
    + " FROM audit"))
reg("full_duplicate_count", _on_audit(Qy.full_duplicate_count), with_audit(
    "SELECT CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS duplicate_rows FROM "
    f"(SELECT COUNT(*) AS c FROM audit GROUP BY {RAW_COLS} HAVING COUNT(*) > 1) d"))
reg("clean_sales_lines", _on_sl(lambda sl: sl), with_sl(
    "SELECT row_id, order_id, order_date, ship_date, ship_mode, customer_id, "
    "customer_name, segment, country, city, state, postal_code, region, product_id, category, "
    "sub_category, product_name, sales, quantity, discount, profit FROM sl_full", SL_FULL))
reg("duplicate_keys", _on_audit(lambda raw: Qy.duplicate_keys(C.rename(raw))), with_audit(
    "SELECT \"Row ID\" AS row_id, CAST(COUNT(*) AS BIGINT) AS duplicate_count FROM audit "
    "GROUP BY 1 HAVING COUNT(*) > 1"))
reg("sample_rows", _on_raw(lambda raw: Qy.sample_rows(
    C.rename(raw), order=("row_id", "order_date", "ship_date"))), with_raw(
    'SELECT "Order Date" AS order_date, "Ship Date" AS ship_date FROM raw '
    'ORDER BY "Row ID", "Order Date", "Ship Date" LIMIT 5'))
reg("clean_product_names", _on_raw(C.clean_product_names), with_raw(
    "SELECT DISTINCT \"Product ID\" AS product_id, "
    "trim(regexp_replace(replace(\"Product Name\", '�', ' '), '\\s+', ' ', 'g')) AS product_name "
    "FROM raw"))
reg("corrupt_name_report", _on_raw(lambda raw: Qy.corrupt_name_report(C.rename(raw))), with_raw(
    "SELECT \"Customer Name\" AS customer_name, CAST(COUNT(*) AS BIGINT) AS records_count FROM raw "
    "WHERE \"Customer Name\" LIKE '%�%' GROUP BY 1 ORDER BY records_count DESC"))
reg("fix_customer_names",
    lambda spark, sf: C.fixed_customer_names(bronze_lines(spark, sf), name_corrections(spark, sf)),
    with_sl(f"SELECT DISTINCT {CUST} FROM sl"))
reg("invalid_dates", _on_audit(Qy.invalid_dates), with_audit(f"SELECT {RAW_COLS} FROM audit WHERE {_BAD_DATE}"))
reg("bad_ship_dates", _on_sl(Qy.bad_ship_dates), with_sl("SELECT * FROM sl WHERE ship_date < order_date"))
reg("negative_sales", lambda spark, sf: Qy.negative_sales(audit_clean_lines(spark, sf)), with_sl(
    "SELECT * FROM audit_clean WHERE sales < 0", SL_FULL, AUDIT_CLEAN))
reg("bad_quantity", lambda spark, sf: Qy.bad_quantity(audit_clean_lines(spark, sf)), with_sl(
    "SELECT * FROM audit_clean WHERE quantity <= 0", SL_FULL, AUDIT_CLEAN))
reg("discount_levels", _on_sl(Qy.discount_levels),
    with_sl("SELECT DISTINCT discount FROM sl ORDER BY discount"))
reg("value_ranges", _on_sl(Qy.value_ranges), with_sl(
    "SELECT CAST(MIN(sales) AS DECIMAL(18,2)) AS min_sales, CAST(MAX(sales) AS DECIMAL(18,2)) AS max_sales, "
    "CAST(MIN(profit) AS DECIMAL(18,2)) AS min_profit, CAST(MAX(profit) AS DECIMAL(18,2)) AS max_profit FROM sl"))
reg("loss_lines", _on_sl(Qy.loss_lines), with_sl("SELECT * FROM sl WHERE profit < 0"))
reg("date_span", _on_sl(Qy.date_span), with_sl(
    "SELECT MIN(order_date) AS first_order_date, MAX(order_date) AS last_order_date FROM sl"))
reg("row_count_clean", _on_sl(lambda sl: Qy.row_count(sl, "cleaned_rows")),
    with_sl("SELECT CAST(COUNT(*) AS BIGINT) AS cleaned_rows FROM sl"))
reg("entity_counts", _on_sl(Qy.entity_counts), with_sl(
    f"SELECT {cnt('COUNT(DISTINCT order_id)')} AS total_orders, "
    f"{cnt('COUNT(DISTINCT customer_id)')} AS total_customers, "
    f"{cnt('COUNT(DISTINCT product_id)')} AS total_products FROM sl"))

_NULLS = " OR ".join(f'"{c}" IS NULL' for c in
                     ["Order ID", "Order Date", "Customer ID", "Product ID", "Sales", "Quantity", "Profit"])
reg("quality_summary", _on_audit(Qy.quality_summary), with_audit(
    "SELECT * FROM (" + " UNION ALL ".join([
        "SELECT 'rows' AS \"check\", CAST(COUNT(*) AS BIGINT) AS violations FROM audit",
        f"SELECT 'missing_values', CAST(COUNT(*) FILTER (WHERE {_NULLS}) AS BIGINT) FROM audit",
        "SELECT 'duplicate_rows', CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) FROM "
        f"(SELECT COUNT(*) AS c FROM audit GROUP BY {RAW_COLS} HAVING COUNT(*) > 1) d",
        f"SELECT 'invalid_dates', CAST(COUNT(*) FILTER (WHERE {_BAD_DATE}) AS BIGINT) FROM audit",
        f"SELECT 'shipped_before_ordered', CAST(COUNT(*) FILTER (WHERE {_SD} < {_OD}) AS BIGINT) FROM audit",
        "SELECT 'negative_sales', CAST(COUNT(*) FILTER (WHERE CAST(\"Sales\" AS DECIMAL(12,2)) < 0) "
        "AS BIGINT) FROM audit",
        "SELECT 'invalid_quantity', CAST(COUNT(*) FILTER (WHERE \"Quantity\" <= 0) AS BIGINT) FROM audit",
    ]) + ") q"))

reg("load_figures", load_figures, with_sl(
    "SELECT * FROM (" + " UNION ALL ".join([
        "SELECT 'raw_rows' AS figure, CAST(COUNT(*) AS BIGINT) AS rows FROM audit",
        f"SELECT 'missing_values', CAST(COUNT(*) FILTER (WHERE {_NULLS}) AS BIGINT) FROM audit",
        *[f"SELECT '{name}', CAST(COUNT(*) FILTER (WHERE {rule}) AS BIGINT) FROM audit_clean" for name, rule in [
            ("clean_rows", "TRUE"), ("shipped_before_ordered", "ship_date < order_date"), ("negative_sales", "sales < 0"),
            ("invalid_quantity", "quantity <= 0"), ("loss_lines", "profit < 0"),
            ("missing_dates", "order_date IS NULL OR ship_date IS NULL")]],
    ]) + ") f", SL_FULL, RAW_CTE, AUDIT_CTE, AUDIT_CLEAN))

# ------------------------------------------------------------- exploratory

reg("business_overview", _on_sl(A.business_overview), with_sl(
    f"SELECT {SALES} AS total_sales, {PROFIT} AS total_profit, "
    f"{cnt('COUNT(DISTINCT order_id)')} AS total_orders, {cnt('COUNT(DISTINCT customer_id)')} AS total_customers, "
    f"{cnt('COUNT(DISTINCT product_id)')} AS total_products, {MARGIN} AS profit_margin_pct FROM sl"))
reg("average_order_value", _on_sl(A.average_order_value), with_sl(
    f"SELECT {round_ratio('SUM(sales)', 'COUNT(DISTINCT order_id)')} AS average_order_value FROM sl"))
reg("sales_by_category", _on_sl(lambda sl: A.sales_by(sl, "category")), with_sl(
    f"SELECT category, {SALES} AS total_sales, {PROFIT} AS total_profit FROM sl GROUP BY category "
    "ORDER BY total_sales DESC NULLS FIRST"))
reg("sales_by_sub_category", _on_sl(lambda sl: A.sales_by(sl, "sub_category")), with_sl(
    f"SELECT sub_category, {SALES} AS total_sales, {PROFIT} AS total_profit FROM sl GROUP BY sub_category "
    "ORDER BY total_sales DESC NULLS FIRST"))
reg("region_performance", _on_sl(A.region_performance), with_sl(
    f"SELECT region, {SALES} AS sales, {PROFIT} AS profit, {MARGIN} AS profit_margin_pct FROM sl "
    "GROUP BY region ORDER BY profit_margin_pct DESC NULLS FIRST"))
reg("top_states_by_sales",
    _on_sl(lambda sl: A.top_by(sl, ["state"], M.money(F.sum("sales")), "total_sales")),
    with_sl(f"SELECT state, {SALES} AS total_sales FROM sl GROUP BY state "
            "ORDER BY total_sales DESC NULLS FIRST, state LIMIT 10"))
reg("top_states_by_profit",
    _on_sl(lambda sl: A.top_by(sl, ["state"], M.money(F.sum("profit")), "total_profit")),
    with_sl(f"SELECT state, {PROFIT} AS total_profit FROM sl GROUP BY state "
            "ORDER BY total_profit DESC NULLS FIRST, state LIMIT 10"))
reg("loss_states", _on_sl(lambda sl: A.loss_groups(sl, ["state"])), with_sl(
    f"SELECT state, {SALES} AS total_sales, {PROFIT} AS total_profit FROM sl GROUP BY state "
    "HAVING SUM(profit) < 0 ORDER BY total_profit"))
reg("sales_by_year", _on_sl(TS.sales_by_year), with_sl(
    f"SELECT CAST(EXTRACT(YEAR FROM order_date) AS BIGINT) AS year, {SALES} AS total_sales, "
    f"{PROFIT} AS total_profit FROM sl GROUP BY 1 ORDER BY 1"))
reg("sales_by_month", _on_sl(TS.sales_by_month), with_sl(
    f"SELECT CAST(DATE_TRUNC('month', order_date) AS DATE) AS month, {SALES} AS total_sales, "
    f"{PROFIT} AS total_profit FROM sl GROUP BY 1 ORDER BY 1"))
reg("yoy_growth", _on_sl(TS.yoy_growth), with_sl(
    f"SELECT year, {money('s')} AS sales, {money('s - LAG(s) OVER (ORDER BY year)')} AS growth FROM "
    "(SELECT CAST(EXTRACT(YEAR FROM order_date) AS BIGINT) AS year, SUM(sales) AS s FROM sl GROUP BY 1) y"))
reg("ship_mode_summary", _on_sl(A.ship_mode_summary), with_sl(
    f"SELECT ship_mode, CAST(COUNT(*) AS BIGINT) AS orders_count, {SALES} AS total_sales, "
    f"{PROFIT} AS total_profit FROM sl GROUP BY ship_mode ORDER BY total_sales DESC NULLS FIRST"))
reg("avg_shipping_days", _on_sl(A.avg_shipping_days), with_sl(
    f"SELECT {mean('(ship_date - order_date)')} AS avg_shipping_days FROM sl"))
reg("revenue_share", _on_sl(A.revenue_share), with_sl(
    f"SELECT category, {SALES} AS total_sales, "
    f"{round_ratio('SUM(sales)', '(SELECT SUM(sales) FROM sl)', 100)} AS share_pct "
    "FROM sl GROUP BY category ORDER BY total_sales DESC NULLS FIRST"))

# ----------------------------------------------------------------- customers

CS = f"cs AS (SELECT {CUST}, SUM(sales) AS ts FROM sl GROUP BY {CUST})"
RFM = (f"rfm AS (SELECT {CUST}, MAX(order_date) AS last_order_date, "
       "CAST((SELECT MAX(order_date) FROM sl) - MAX(order_date) AS BIGINT) AS recency_days, "
       f"CAST(COUNT(DISTINCT order_id) AS BIGINT) AS frequency, SUM(sales) AS monetary FROM sl GROUP BY {CUST})")
SCORES = (f"scores AS (SELECT *, "
          f"CAST(NTILE(5) OVER (ORDER BY recency_days ASC NULLS LAST, {CUST}) AS BIGINT) AS r_score, "
          f"CAST(NTILE(5) OVER (ORDER BY frequency DESC NULLS FIRST, {CUST}) AS BIGINT) AS f_score, "
          f"CAST(NTILE(5) OVER (ORDER BY monetary DESC NULLS FIRST, {CUST}) AS BIGINT) AS m_score FROM rfm)")
SEGS = ("segs AS (SELECT *, CASE "
        "WHEN r_score = 5 AND f_score >= 4 AND m_score >= 4 THEN 'Champions' "
        "WHEN r_score >= 4 AND f_score >= 3 THEN 'Loyal Customers' "
        "WHEN r_score >= 4 AND f_score <= 2 THEN 'Potential Loyalists' "
        "WHEN r_score <= 2 AND f_score >= 3 THEN 'At Risk' "
        "ELSE 'Others' END AS customer_segment FROM scores)")

reg("customer_overview", _on_sl(A.customer_overview), with_sl(
    f"SELECT {cnt('COUNT(DISTINCT customer_id)')} AS total_customers, {SALES} AS total_sales, "
    f"{PROFIT} AS total_profit FROM sl"))
reg("top_customers_by_sales", _on_sl(U.top_customers_by_sales), with_sl(
    f"SELECT {CUST}, {SALES} AS total_sales FROM sl GROUP BY {CUST} "
    f"ORDER BY total_sales DESC NULLS FIRST, {CUST} LIMIT 10"))
reg("top_customers_by_profit", _on_sl(U.top_customers_by_profit), with_sl(
    f"SELECT {CUST}, {PROFIT} AS total_profit FROM sl GROUP BY {CUST} "
    f"ORDER BY total_profit DESC NULLS FIRST, {CUST} LIMIT 10"))
reg("customer_sales_rank", _on_sl(U.customer_sales_rank), with_sl(
    f"SELECT {CUST}, {money('ts')} AS total_sales, "
    "CAST(RANK() OVER (ORDER BY ts DESC NULLS FIRST) AS BIGINT) AS sales_rank FROM cs", CS))
reg("repeat_customers", _on_sl(U.repeat_customers), with_sl(
    f"SELECT {CUST}, {cnt('COUNT(DISTINCT order_id)')} AS total_orders FROM sl GROUP BY {CUST} "
    "HAVING COUNT(DISTINCT order_id) > 1 ORDER BY total_orders DESC"))
reg("segment_performance", _on_sl(U.segment_performance), with_sl(
    f"SELECT segment, {cnt('COUNT(DISTINCT customer_id)')} AS customers, {SALES} AS total_sales, "
    f"{PROFIT} AS total_profit FROM sl GROUP BY segment ORDER BY total_sales DESC NULLS FIRST"))
reg("customer_lifetime_value", _on_sl(U.customer_lifetime_value), with_sl(
    f"SELECT {CUST}, {cnt('COUNT(DISTINCT order_id)')} AS total_orders, {SALES} AS lifetime_sales, "
    f"{PROFIT} AS lifetime_profit FROM sl GROUP BY {CUST} ORDER BY lifetime_sales DESC NULLS FIRST"))
reg("customer_value_tier", _on_sl(U.customer_value_tier), with_sl(
    f"SELECT {CUST}, {money('ts')} AS total_sales, CASE WHEN ts >= 10000 THEN 'VIP' "
    "WHEN ts >= 5000 THEN 'Regular' ELSE 'Low Value' END AS customer_segment FROM cs "
    "ORDER BY total_sales DESC NULLS FIRST", CS))
reg("rfm_metrics", _on_sl(U.rfm_metrics), with_sl(
    f"SELECT {CUST}, last_order_date, recency_days, frequency, {money('monetary')} AS monetary "
    "FROM rfm ORDER BY monetary DESC NULLS FIRST", RFM))
reg("rfm_scores", _on_sl(U.rfm_scores), with_sl(
    f"SELECT {CUST}, recency_days, frequency, CAST(monetary AS DECIMAL(18,2)) AS monetary, "
    "r_score, f_score, m_score FROM scores", RFM, SCORES))
reg("rfm_segments", _on_sl(U.rfm_segments), with_sl(
    f"SELECT {CUST}, recency_days, frequency, {money('monetary')} AS monetary, r_score, f_score, "
    "m_score, customer_segment FROM segs ORDER BY monetary DESC NULLS FIRST", RFM, SCORES, SEGS))
reg("rfm_segment_summary", _on_sl(U.rfm_segment_summary), with_sl(
    f"SELECT customer_segment, CAST(COUNT(*) AS BIGINT) AS customers_count, "
    f"{money('SUM(monetary)')} AS total_sales, {mean('monetary')} AS avg_customer_sales "
    "FROM segs GROUP BY customer_segment ORDER BY total_sales DESC NULLS FIRST", RFM, SCORES, SEGS))
reg("rfm_segment_rank", _on_sl(U.rfm_segment_rank), with_sl(
    f"SELECT customer_segment, customer_name, {money('monetary')} AS total_sales, "
    "CAST(RANK() OVER (PARTITION BY customer_segment ORDER BY monetary DESC NULLS FIRST) AS BIGINT) "
    "AS segment_rank FROM segs ORDER BY customer_segment, segment_rank", RFM, SCORES, SEGS))

# ------------------------------------------------------------------ products

PS_ID = f"ps AS (SELECT {PROD}, SUM(sales) AS ts FROM sl GROUP BY {PROD})"
PS_NAME = "ps AS (SELECT product_name, SUM(sales) AS ts FROM sl GROUP BY product_name)"
CUM = ("cum AS (SELECT *, SUM(ts) OVER (ORDER BY ts DESC NULLS FIRST) AS c, "
       "CAST(SUM(ts) OVER () AS DECIMAL(18,2)) AS overall FROM ps)")


def _share(bounds: list[tuple[str, str]], default: str) -> str:
    whens = " ".join(f"WHEN c / overall <= {b} THEN '{label}'" for b, label in bounds)
    return f"CASE {whens} ELSE '{default}' END"


# Class bounds and labels.
ABC = _share([("0.80", "A"), ("0.95", "B")], "C")
PARETO = _share([("0.80", "Top 80% Revenue Products")], "Remaining Products")

reg("product_overview", _on_sl(P.product_overview), with_sl(
    f"SELECT {cnt('COUNT(DISTINCT product_id)')} AS total_products, {SALES} AS total_sales, "
    f"{PROFIT} AS total_profit FROM sl"))
reg("top_products_by_sales", _on_sl(P.top_products_by_sales), with_sl(
    f"SELECT {PROD}, {SALES} AS total_sales FROM sl GROUP BY {PROD} "
    f"ORDER BY total_sales DESC NULLS FIRST, {PROD} LIMIT 10"))
reg("top_products_by_profit", _on_sl(P.top_products_by_profit), with_sl(
    f"SELECT {PROD}, {PROFIT} AS total_profit FROM sl GROUP BY {PROD} "
    f"ORDER BY total_profit DESC NULLS FIRST, {PROD} LIMIT 10"))
reg("loss_products", _on_sl(P.loss_products), with_sl(
    f"SELECT {PROD}, {PROFIT} AS total_profit FROM sl GROUP BY {PROD} HAVING SUM(profit) < 0 "
    f"ORDER BY total_profit, {PROD} LIMIT 10"))
reg("category_performance", _on_sl(P.category_performance), with_sl(
    f"SELECT category, {SALES} AS total_sales, {PROFIT} AS total_profit, {MARGIN} AS profit_margin_pct "
    "FROM sl GROUP BY category ORDER BY total_sales DESC NULLS FIRST"))
reg("sub_category_performance", _on_sl(P.sub_category_performance), with_sl(
    f"SELECT sub_category, {SALES} AS total_sales, {PROFIT} AS total_profit FROM sl "
    "GROUP BY sub_category ORDER BY total_sales DESC NULLS FIRST"))
reg("product_sales_rank", _on_sl(P.product_sales_rank), with_sl(
    f"SELECT {PROD}, {money('ts')} AS total_sales, "
    "CAST(RANK() OVER (ORDER BY ts DESC NULLS FIRST) AS BIGINT) AS sales_rank FROM ps", PS_ID))
reg("top_product_per_category", _on_sl(P.top_product_per_category), with_sl(
    f"SELECT category, product_name, {money('ts')} AS total_sales FROM "
    "(SELECT category, product_name, SUM(sales) AS ts, ROW_NUMBER() OVER (PARTITION BY category "
    "ORDER BY SUM(sales) DESC NULLS FIRST, product_name ASC NULLS LAST) AS rn FROM sl "
    "GROUP BY category, product_name) t WHERE rn = 1"))
reg("products_above_average", _on_sl(P.products_above_average), with_sl(
    f"SELECT product_name, {money('ts')} AS total_sales FROM ps "
    "WHERE ts * (SELECT COUNT(ts) FROM ps) > (SELECT SUM(ts) FROM ps) "
    "ORDER BY total_sales DESC NULLS FIRST", PS_NAME))
reg("abc_summary", _on_sl(P.abc_summary), with_sl(
    f"SELECT abc_category, CAST(COUNT(*) AS BIGINT) AS products_count, {money('SUM(ts)')} AS total_sales "
    f"FROM (SELECT ts, {ABC} AS abc_category FROM cum) a GROUP BY abc_category ORDER BY abc_category",
    PS_NAME, CUM))
reg("abc_classes", _on_sl(P.abc_classes), with_sl(
    f"SELECT product_name, {money('ts')} AS total_sales, {ABC} AS abc_category FROM cum",
    PS_NAME, CUM))
reg("pareto_table", _on_sl(P.pareto_table), with_sl(
    f"SELECT {PROD}, {money('ts')} AS total_sales, {round_ratio('c', 'overall', 100)} "
    "AS cumulative_sales_pct FROM cum ORDER BY total_sales DESC NULLS FIRST", PS_ID, CUM))
reg("pareto_80_count", _on_sl(P.pareto_80_count), with_sl(
    "SELECT CAST(COUNT(*) AS BIGINT) AS products_generating_80pct_sales FROM cum "
    "WHERE c / overall <= 0.80", PS_ID, CUM))
reg("pareto_groups", _on_sl(P.pareto_groups), with_sl(
    f"SELECT pareto_group, CAST(COUNT(*) AS BIGINT) AS products_count, {money('SUM(ts)')} AS total_sales "
    f"FROM (SELECT ts, {PARETO} AS pareto_group FROM cum) g GROUP BY pareto_group", PS_ID, CUM))

# ------------------------------------------------------------- profitability

PM = ("pm AS (SELECT product_name, SUM(sales) AS s, SUM(profit) AS p FROM sl GROUP BY product_name), "
      "av AS (SELECT SUM(s) AS gs, COUNT(s) AS ns, SUM(p) AS gp, COUNT(p) AS np FROM pm)")

reg("discount_impact", _on_sl(R.discount_impact), with_sl(
    f"SELECT discount, CAST(COUNT(*) AS BIGINT) AS orders_count, {SALES} AS total_sales, "
    f"{PROFIT} AS total_profit, {mean('profit')} AS avg_profit FROM sl GROUP BY discount ORDER BY discount"))
reg("discount_bands", _on_sl(R.discount_bands), with_sl(
    "SELECT CASE WHEN discount = 0 THEN 'No Discount' WHEN discount <= 0.20 THEN 'Low Discount' "
    "WHEN discount <= 0.50 THEN 'Medium Discount' ELSE 'High Discount' END AS discount_group, "
    f"CAST(COUNT(*) AS BIGINT) AS orders_count, {SALES} AS total_sales, {PROFIT} AS total_profit "
    "FROM sl GROUP BY 1 ORDER BY total_sales DESC NULLS FIRST"))
reg("loss_orders", _on_sl(R.loss_orders), with_sl(
    f"SELECT order_id, {SALES} AS total_sales, {PROFIT} AS total_profit FROM sl GROUP BY order_id "
    "HAVING SUM(profit) < 0 ORDER BY total_profit"))
reg("worst_orders", _on_sl(R.worst_orders), with_sl(
    f"SELECT order_id, {SALES} AS total_sales, {PROFIT} AS total_profit FROM sl GROUP BY order_id "
    "ORDER BY total_profit, order_id LIMIT 10"))
reg("region_profitability", _on_sl(R.region_profitability), with_sl(
    f"SELECT region, {SALES} AS total_sales, {PROFIT} AS total_profit, {MARGIN} AS profit_margin_pct "
    "FROM sl GROUP BY region ORDER BY profit_margin_pct DESC NULLS FIRST"))
reg("state_profitability", _on_sl(R.state_profitability), with_sl(
    f"SELECT state, {SALES} AS total_sales, {PROFIT} AS total_profit, {MARGIN} AS profit_margin_pct "
    "FROM sl GROUP BY state ORDER BY total_profit DESC NULLS FIRST"))
reg("shipping_performance", _on_sl(A.shipping_performance), with_sl(
    f"SELECT ship_mode, CAST(COUNT(*) AS BIGINT) AS orders_count, {SALES} AS total_sales, "
    f"{PROFIT} AS total_profit, {mean('(ship_date - order_date)')} AS avg_shipping_days "
    "FROM sl GROUP BY ship_mode ORDER BY total_sales DESC NULLS FIRST"))
reg("profitability_matrix", _on_sl(R.profitability_matrix), with_sl(
    f"SELECT product_name, {money('s')} AS total_sales, {money('p')} AS total_profit, CASE "
    "WHEN s * ns >= gs AND p * np >= gp THEN 'High Sales / High Profit' "
    "WHEN s * ns >= gs AND p * np < gp THEN 'High Sales / Low Profit' "
    "WHEN s * ns < gs AND p * np >= gp THEN 'Low Sales / High Profit' "
    "ELSE 'Low Sales / Low Profit' END AS profitability_segment FROM pm CROSS JOIN av", PM))
reg("category_discount", _on_sl(R.category_discount), with_sl(
    f"SELECT category, {mean('discount')} AS avg_discount, {SALES} AS total_sales, "
    f"{PROFIT} AS total_profit FROM sl GROUP BY category ORDER BY total_profit DESC NULLS FIRST"))
reg("high_discount_products", _on_sl(R.high_discount_products), with_sl(
    f"SELECT product_name, {mean('discount')} AS avg_discount, {PROFIT} AS total_profit FROM sl "
    "GROUP BY product_name HAVING SUM(discount) >= 0.30 * COUNT(discount) "
    "ORDER BY avg_discount DESC NULLS FIRST"))


# ----------------------------------------------------------- load by load

# These build tables anew on every call: not part of the bench's sum.
LOAD_KEYS = ("clean_lines_by_loads", "rfm_metrics_by_loads", "load_figures")
reg("clean_lines_by_loads", clean_lines_by_loads, REGISTRY["clean_sales_lines"][1])
reg("rfm_metrics_by_loads", rfm_metrics_by_loads, REGISTRY["rfm_metrics"][1])


def queries() -> dict[str, Builder]:
    return {k: b for k, (b, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in REGISTRY.items() if s is not None}


__all__ = ["REGISTRY", "queries", "oracle_sql"]
