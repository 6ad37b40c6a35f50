"""Named queries with their SQL oracle, plan inspection, plan reports and
result tables."""
