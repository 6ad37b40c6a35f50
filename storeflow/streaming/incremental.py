"""The breakdowns, kept current while order-line files arrive.

The analyses are batch queries; nothing in them is stream-specific.  When
clean order lines land as files in a folder, Structured Streaming runs the
same grouped sums incrementally: each micro-batch adds its partial sums to
the state store, and the updated result is written as a Parquet table.
State is one row per group key, so only low- or mid-cardinality dimensions
belong here.  Exact distinct counts are not available on streams and are
not offered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import money as M
from ..operators.aggregates import line_count
from ..session import stable_path


def read_lines(spark: SparkSession, folder: str, like: DataFrame,
               max_files_per_trigger: int | None = None) -> DataFrame:
    """Order-line Parquet files in ``folder`` as a stream with ``like``'s schema."""
    reader = spark.readStream.schema(like.schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(folder)


def running_totals(lines: DataFrame, dim: str) -> DataFrame:
    """Lines, sales and profit per value of ``dim`` (streaming aggregate)."""
    return lines.groupBy(dim).agg(
        line_count(),
        M.money(M.sum_money("sales")).alias("total_sales"),
        M.money(M.sum_money("profit")).alias("total_profit"),
    )


def start(totals: DataFrame, name: str, table: str, checkpoint: str | None = None) -> StreamingQuery:
    """Keep the totals current as the Parquet table at ``table``: every
    micro-batch writes the whole result anew, by tasks (nothing reaches the
    driver).  Progress is kept in the shared checkpoint folder under the
    query name (not the application), so a restarted driver resumes where
    it stopped."""
    location = checkpoint or stable_path(totals.sparkSession, "streams", name)

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(table)

    return (totals.writeStream.queryName(name).outputMode("complete")
            .option("checkpointLocation", location).foreachBatch(write).start())
