"""The analyses' tables built up load by load, as queries: the results are
those of the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.customer_state import customer_state, merge_states, rfm_base_of
from ..operators.customers import rfm_metrics
from ..session import scratch_path, spread_shuffles
from ..sources.raw import bronze_lines, name_corrections
from ..sources.silver import silver_lines
from ..sources.snapshot import Snapshot
from ..sources.storage import fingerprint, materialize, size_of, write_table
from ..sources.tables import line_sources

LOADS = 3


def _source_bytes(spark: SparkSession, sf_dir: str) -> int:
    return size_of(fingerprint(spark, line_sources(sf_dir)))


def clean_lines_by_loads(spark: SparkSession, sf_dir: str, loads: int = LOADS) -> DataFrame:
    """The clean order lines of a snapshot after ``loads`` loads of raw
    files (all raw lines, dealt by order)."""
    raw = bronze_lines(spark, sf_dir)
    place = scratch_path(spark, "loads", uuid.uuid4().hex)
    snapshot = Snapshot(
        spark, f"{place}/raw", f"{place}/snapshot", corrections=name_corrections(spark, sf_dir),
        read=lambda s, paths: s.read.schema(raw.schema).parquet(*paths))
    with spread_shuffles(spark, _source_bytes(spark, sf_dir)):
        for k in range(loads):
            write_table(raw.where(F.pmod(F.xxhash64("Order ID"), F.lit(loads)) == k), f"{place}/raw/load={k}")
            snapshot.load()
    return snapshot.lines()


def rfm_metrics_by_loads(spark: SparkSession, sf_dir: str, loads: int = LOADS) -> DataFrame:
    """``rfm_metrics`` from states that were merged load by load (all clean
    lines, dealt by line, so that orders are split between loads)."""
    sl = silver_lines(spark, sf_dir)
    state = None
    with spread_shuffles(spark, _source_bytes(spark, sf_dir)):
        for k in range(loads):
            new = customer_state(sl.where(F.pmod(F.xxhash64("row_id"), F.lit(loads)) == k))
            state = materialize(new if state is None else merge_states(state, new), "customer-state")
    return rfm_metrics(sl, rfm_base_of(state))
