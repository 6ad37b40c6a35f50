"""Helpers shared by the operators: tables, written intermediates, ranks."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# The ASCII letters that "lower-case A-Z only" maps.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
# Fixed value: the white space that separates words, as a regex class body.
WORD_SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty_if_null(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where the
    body is a lambda that runs many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")


def write_table(df: DataFrame, name: str, rows_per_file: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts
    the lineage, so a lost executor recomputes nothing upstream, and gives
    the planner exact sizes."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*frames: DataFrame) -> None:
    """Remove tables written by ``write_table`` that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/llm/" in path:
                drop_folder(spark, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def with_position(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` range-partitioned and sorted on ``order``, written once with
    ``_part`` (range number) and ``_idx`` (0-based place in the range).

    Ranges follow the order, so place in the whole = rows of lower ranges +
    ``_idx``.  Range partitioning splits a value held by many rows as long
    as ``order`` ends in a unique column.
    """
    cols = [F.col(c).asc_nulls_last() for c in order]
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    mid = F.monotonically_increasing_id()
    return write_table(
        ranged.withColumn("_mid", mid)
        .withColumn("_part", F.shiftright("_mid", 33).cast("int"))
        .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid"),
        name,
    )


def class_offsets(positioned: DataFrame, cls: str) -> list[tuple]:
    """``(class, part, first_idx, count)`` of a ``with_position`` table
    ordered by ``cls`` first.  A range boundary splits at most one class, so
    this is at most (classes + ranges) rows: collect only for a class count
    that the operator bounds."""
    rows = (
        positioned.groupBy(cls, "_part")
        .agg(F.min("_idx").alias("first"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    return sorted((r[cls], r["_part"], r["first"], r["n"]) for r in rows)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see at once which shuffles nothing refers to any
    more (it removes their files), instead of at the driver's next
    collection."""
    gc.collect()
    spark._jvm.System.gc()
