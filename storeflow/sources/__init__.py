"""Sources and sinks: raw files, the driver tables shaped into order lines
(silver / bronze), and written intermediate tables."""
