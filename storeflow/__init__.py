"""storeflow: retail sales analytics as Spark DataFrame operators.

Clean and validate order lines, then profile them by KPI, dimension,
period, customer (value tiers, RFM), product (rankings, ABC, Pareto) and
profit driver.  Every operator takes a DataFrame of clean order lines and
returns a DataFrame; thresholds and columns are arguments.  Most are lazy;
ordered scans (rankings, NTILE, ABC, Pareto) and the duplicate check write
and count intermediate tables while the frame is built.
"""

__all__ = ["__version__"]
__version__ = "0.1.0"
