"""The same breakdowns kept current over arriving order-line files."""
