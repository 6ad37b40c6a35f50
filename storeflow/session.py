"""Session helpers.

The library never creates a session behind the caller's back: every
operator takes DataFrames.  ``local_session`` exists for tests, the bench
and ad-hoc runs; on a cluster the platform's session is used as is.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the library relies on.  ANSI mode makes decimal overflow and
# division by zero raise (as PostgreSQL does); AQE re-plans joins and
# shuffle partition counts from runtime sizes and splits skewed joins.
REQUIRED_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


# Bytes of source files (Parquet: about 280,000 order lines) a shuffle
# partition stands for, the most partitions of a shuffle, and the bytes of
# written tables a scan task reads where shuffles are spread.
PARTITION_SOURCE_BYTES = 4 << 20
MOST_PARTITIONS = 4096
SCAN_BYTES = 16 << 20
# Bytes of a batch between the JVM and a Python worker where rows are long.
BATCH_BYTES = 4 << 20


def local_session(
    cores: int | str = "*",
    shuffle_partitions: int = 8,
    app_name: str = "storeflow",
    extra: dict[str, str] | None = None,
    checkpoint_dir: str | None = None,
) -> SparkSession:
    """A local session configured like the tests and the bench expect;
    ``checkpoint_dir`` is where written tables go."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", checkpoint_dir or tempfile.mkdtemp(prefix="storeflow-ckpt-"))
        # Small local files: count the cost of opening a file as 1 MB (not
        # 4 MB) so that each few-MB file gets its own scan task.
        .config("spark.sql.files.openCostInBytes", str(1 << 20))
    )
    for key, value in {**REQUIRED_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names reliable shared storage and is only
    read; a session of several processes without it is an error.  In a
    local session (one process) without it a fresh scratch folder is
    created and set.  Also checks the settings that exact results rest on.
    """
    check_settings(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", "") or ""
        if not re.fullmatch(r"local(\[.*\])?", master):
            # A machine-local folder is not visible to executors elsewhere.
            raise ValueError("set spark.checkpoint.dir to a shared folder (HDFS, object store)")
        configured = tempfile.mkdtemp(prefix="storeflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def check_settings(spark: SparkSession) -> None:
    """Raise when ANSI mode is off in this session: results would be wrong
    where they must raise.  The other settings of ``REQUIRED_CONF`` only make
    plans better; a session may run without them."""
    if spark.conf.get("spark.sql.ansi.enabled", "true").lower() != "true":
        raise ValueError("setting that must be on: spark.sql.ansi.enabled")


def share_package(spark: SparkSession, root: str) -> None:
    """Let Python workers import this package from ``root`` (a folder that
    they see, as in local sessions; elsewhere ship it with ``--py-files``)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def app_id(spark: SparkSession) -> str:
    return spark.conf.get("spark.app.id", None) or "app"


def parallelism(spark: SparkSession) -> int:
    """Cores the session schedules on (default parallelism)."""
    return spark.sparkContext.defaultParallelism


@contextmanager
def spread_shuffles(spark: SparkSession, source_bytes: int) -> Iterator[None]:
    """For the jobs run inside: shuffle partitions in proportion to the
    files they start from, where the session's number is less.  With a fixed
    number partitions grow with the input until their sorts and aggregates
    spill.  AQE then keeps that many, and written tables are scanned in
    tasks of like size, so that no few long tasks end a stage."""
    wanted = min(-(-source_bytes // PARTITION_SOURCE_BYTES), MOST_PARTITIONS)
    shuffles = "spark.sql.shuffle.partitions"
    if int(spark.conf.get(shuffles)) >= wanted:
        yield
        return
    inside = {shuffles: wanted, "spark.sql.adaptive.coalescePartitions.minPartitionNum": wanted,
              "spark.sql.files.maxPartitionBytes": SCAN_BYTES}
    before = {name: spark.conf.get(name, None) for name in inside}
    for name, value in inside.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """For the jobs run inside: batches to Python workers of ``BATCH_BYTES``
    at most (a longer row is a batch of its own).  Both sides hold a batch
    several times over, outside the heap, in every task that runs."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path for written intermediate tables, under the checkpoint folder.

    Tables are keyed by application id so that concurrent applications
    sharing one folder never overwrite each other.
    """
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "storeflow", app_id(spark), *parts)


def stable_path(spark: SparkSession, *parts: str) -> str:
    """A path under the checkpoint folder that does not depend on the
    application (e.g. a streaming query's progress, which a restarted
    driver must find again)."""
    return os.path.join(ensure_checkpoint_dir(spark), "storeflow", "stable", *parts)
