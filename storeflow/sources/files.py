"""Raw order-line files: CSV (or any Spark format) with the declared raw
schema -- never inferred, so a large load is one pass.  A malformed value
or a truncated line fails the load; with ``corrupt_col`` such lines are
kept whole in that column instead, with NULL for what could not be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import types as T

from ..schema import RAW_SCHEMA


def read_raw(spark: SparkSession, path: str, fmt: str = "csv", corrupt_col: str | None = None,
             **options) -> DataFrame:
    """Read raw order lines from ``path`` (a file, folder or glob).

    CSV defaults: a header row, UTF-8, quoted fields; a line that does not
    fit the schema fails the load, or is kept in ``corrupt_col``.
    Identifier columns that hold numbers in the source are read as text.
    """
    schema = RAW_SCHEMA
    defaults = {"header": "true", "encoding": "UTF-8", "quote": '"', "escape": '"', "mode": "FAILFAST"}
    if corrupt_col:
        schema = T.StructType([*RAW_SCHEMA.fields, T.StructField(corrupt_col, T.StringType())])
        defaults |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt_col}
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.options(**{**defaults, **options}).csv(path)
    return reader.options(**options).format(fmt).load(path)


def write_raw_csv(df: DataFrame, path: str) -> None:
    """Write raw order lines as CSV with a header (``mode("overwrite")``)."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
