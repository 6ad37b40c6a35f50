"""An index of the keys that a growing table holds, bucketed by key.

Each load adds its keys as files of the same buckets, so the keys of a new
load are joined with all earlier ones without an exchange (or sort by range)
on the index side: only the load's keys are shuffled.  A row also names the
part of the table that holds the key; rows of parts that are not among the
caller's are ignored, so a load that was never published leaves nothing
behind that counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


@dataclass(frozen=True)
class KeyIndex:
    """``path``: where the index files lie; ``name``: its name in the
    session's catalog (declared again by every session)."""

    spark: SparkSession
    path: str
    name: str
    key_type: str
    buckets: int = BUCKETS

    def declare(self) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (key {self.key_type}, part STRING) USING parquet "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        self.spark.catalog.refreshTable(self.name)

    def rows(self, parts: Sequence[str]) -> DataFrame:
        self.declare()
        return self.spark.table(self.name).where(F.col("part").isin(list(parts)))

    def add(self, keys: DataFrame, part: str) -> None:
        """Add the keys (one column ``key``) of a part."""
        self.declare()
        (keys.select(F.col("key").cast(self.key_type).alias("key"), F.lit(part).alias("part"))
         .repartition(self.buckets, "key").write.mode("append").format("parquet")
         .bucketBy(self.buckets, "key").sortBy("key").option("path", self.path).saveAsTable(self.name))
        self.spark.catalog.refreshTable(self.name)

    def repeated(self, keys: DataFrame, parts: Sequence[str]) -> DataFrame:
        """``key, times, held``: keys of a load that are NULL, occur more
        than once in it (``times``), or that one of ``parts`` holds."""
        # Dealt out as the buckets are, so that the index need not be.
        own = keys.select(F.col("key").cast(self.key_type).alias("key")).repartition(self.buckets, "key").groupBy("key").agg(F.count(F.lit(1)).alias("times"))
        held = self.rows(parts).select(F.col("key").alias("_held"))
        return (
            own.join(held, F.col("key") == F.col("_held"), "left")
            .select("key", "times", F.col("_held").isNotNull().alias("held"))
            .where(F.col("key").isNull() | (F.col("times") > 1) | F.col("held")).distinct())
