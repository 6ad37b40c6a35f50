"""Written intermediate tables.

A table that several jobs read (the clean order lines, per-entity totals
feeding ordered scans) is written once as Parquet under the shared folder
named by ``spark.checkpoint.dir`` and read back.  That cuts the lineage
(nothing upstream is recomputed after an executor loss), gives later
readers column pruning and filter push-down, and the planner exact sizes.

``materialize`` reuses what it wrote: a frame with the same logical plan
gets the table that the application wrote for it before, so asking for a
ranking twice writes nothing new.

``named_table`` keeps one published version per name.  It notices that a
source's files have changed (paths, sizes, times; see ``fingerprint``) and
builds a new version then; a version is published only after its checks
have passed, else it is removed and the one before stays.  Tables written
from a replaced version are forgotten with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import RAW_TO_CLEAN
from ..session import app_id, scratch_path, spread_shuffles

# (application, name, plan hash) -> [(frame, written table, its folder)]
_WRITTEN: dict[tuple[str, str, int], list[tuple[DataFrame, DataFrame, str]]] = {}
# (application, name) -> published version
_NAMED: dict[tuple[str, str], Version] = {}


@dataclass(frozen=True)
class Version:
    table: DataFrame
    path: str
    sources: tuple
    facts: Any


# Columns of order lines whose values hardly repeat: a writer that collects a
# dictionary of them gives it up after its first megabyte.
NO_DICTIONARY = {name for raw in ("Row ID", "Order ID", "Customer ID", "Product ID", "Sales", "Profit")
                 for name in (raw, RAW_TO_CLEAN[raw])}


def write_options(schema: T.StructType) -> dict[str, str]:
    """What keeps the Parquet writer's work per row small: zstd at its first
    level (the tables get no larger), no size statistics, no smallest and
    largest text per page (filters look for ranges of numbers and dates, and
    those keep theirs) and no dictionaries of ``NO_DICTIONARY``."""
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1",
               "parquet.size.statistics.enabled": "false"}
    for field in schema.fields:
        if isinstance(field.dataType, T.StringType):
            options[f"parquet.column.statistics.enabled#{field.name}"] = "false"
        if field.name in NO_DICTIONARY:
            options[f"parquet.enable.dictionary#{field.name}"] = "false"
    return options


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``df`` as Parquet (``mode("overwrite")`` = drop-if-exists)."""
    df.write.mode(mode).options(**write_options(df.schema)).parquet(path)


def materialize(df: DataFrame, name: str = "tmp") -> DataFrame:
    """Write ``df`` once to the shared folder and return the re-read table."""
    spark = df.sparkSession
    known = _WRITTEN.setdefault((app_id(spark), name, df.semanticHash()), [])
    for source, table, _ in known:
        if source.sameSemantics(df):
            return table
    path = scratch_path(spark, "tables", f"{name}-{uuid.uuid4().hex}")
    write_table(df, path)
    table = spark.read.parquet(path)
    known.append((df, table, path))
    return table


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """What tells whether the files below ``paths`` have changed, by a few
    calls to the file system: path, size and time of a file; path, total
    size, file count and time of a folder."""
    out = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        status = fs.getFileStatus(p)
        if status.isFile():
            out.append((path, status.getLen(), 1, status.getModificationTime()))
        else:
            below = fs.getContentSummary(p)
            out.append((path, below.getLength(), below.getFileCount(), status.getModificationTime()))
    return tuple(out)


def size_of(found: tuple) -> int:
    """The bytes of the files of a ``fingerprint``."""
    return sum(size for _, size, _, _ in found)


def named_table(spark: SparkSession, name: str, build: Callable[[], DataFrame],
                check: Callable[[DataFrame], Any] | None = None, sources: Sequence[str] = ()) -> DataFrame:
    """The application's table ``name``: written by the first call, read
    back by the others until a file of ``sources`` changes (or ``refresh``).
    ``check`` raises when the written table must not be published; what it
    returns is kept as the version's facts."""
    return named_version(spark, name, build, check, sources).table


def named_version(spark: SparkSession, name: str, build: Callable[[], DataFrame],
                  check: Callable[[DataFrame], Any] | None = None, sources: Sequence[str] = ()) -> Version:
    key, now = (app_id(spark), name), fingerprint(spark, sources)
    known = _NAMED.get(key)
    if known is not None and known.sources == now:
        return known
    path = scratch_path(spark, name, uuid.uuid4().hex)
    try:
        with spread_shuffles(spark, size_of(now)):
            write_table(build(), path)
            table = spark.read.parquet(path)
            facts = check(table) if check is not None else None
    except Exception:
        _remove(spark, path)
        raise
    _NAMED[key] = Version(table, path, now, facts)
    if known is not None:
        _forget_readers(spark, known.path)
        _remove(spark, known.path)
    return _NAMED[key]


def _forget_readers(spark: SparkSession, path: str) -> None:
    """Forget and remove what ``materialize`` wrote from the table at
    ``path``."""
    app = app_id(spark)
    for key in [k for k in _WRITTEN if k[0] == app]:
        keep = []
        for entry in _WRITTEN[key]:
            if any(path in f for f in entry[0].inputFiles()):
                _forget_readers(spark, entry[2])
                _remove(spark, entry[2])
            else:
                keep.append(entry)
        _WRITTEN[key] = keep


def forget_intermediates(spark: SparkSession) -> None:
    """Forget and remove what ``materialize`` has written for this
    application; named tables stay."""
    app = app_id(spark)
    for key in [k for k in _WRITTEN if k[0] == app]:
        for _, _, path in _WRITTEN.pop(key):
            _remove(spark, path)


def refresh(spark: SparkSession) -> None:
    """Forget and remove every table this application has written here."""
    forget_intermediates(spark)
    app = app_id(spark)
    for key in [k for k in _NAMED if k[0] == app]:
        _remove(spark, _NAMED.pop(key).path)
    _remove(spark, scratch_path(spark, "loads"))  # of the queries that build tables load by load


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
