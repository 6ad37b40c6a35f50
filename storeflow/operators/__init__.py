"""Operators over clean order lines (DataFrame -> DataFrame): aggregates,
time series, customers (RFM), products (ABC / Pareto), profitability,
cleaning, quality checks, and the distributed ordered scan."""
