"""Incremental snapshots: clean order lines of a folder of raw files.

A snapshot is a folder with numbered versions.  A version names the parts
(Parquet folders of clean lines) that make it up, and the manifest of the
source files behind them (path, size, modification time, part).  ``load``
compares the folder with the last version's manifest:

* files that are new, or changed, are read, cleaned and written as a part;
* parts that hold lines of files that changed or went are written anew
  without those lines, from the clean lines themselves;
* all other source files are not read, all other parts not touched.

The new parts are checked before anything is published (the rules of
``load_checks`` while they are written; the key against the load itself and,
by the bucketed ``KeyIndex``, against all other parts).  A version is
published by creating its file, which fails if another load was first; a
load that fails leaves the version before in place.  Readers see one
version: the parts of a published version are never changed.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean
from .files import read_raw
from .key_index import KeyIndex
from .load_checks import Load, LoadRefused
from .storage import write_table

SOURCE = "_source"  # the raw file that a clean line came from


@dataclass(frozen=True)
class SnapshotVersion:
    number: int
    parts: tuple[str, ...] = ()
    manifest: str | None = None
    figures: Mapping[str, int] = field(default_factory=dict)  # of the load that made it
    files_read: int = 0


class Snapshot:
    """Clean order lines at ``root`` (a shared folder) of the raw files in
    ``folder``; ``read`` gives the raw lines of a list of files."""

    def __init__(self, spark: SparkSession, folder: str, root: str,
                 read: Callable[[SparkSession, list[str]], DataFrame] = read_raw,
                 corrections: DataFrame | None = None, limits: Mapping[str, int] | None = None,
                 key: str | None = "row_id", key_type: str = "string", buckets: int = 64):
        self.spark, self.folder, self.root, self.read = spark, folder, root.rstrip("/"), read
        self.corrections, self.limits, self.key = corrections, limits or {}, key
        name = "keys_" + uuid.uuid5(uuid.NAMESPACE_URL, self.root).hex
        self.index = KeyIndex(spark, f"{self.root}/keys", name, key_type, buckets)

    # ------------------------------------------------------------- versions

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> SnapshotVersion:
        """The last published version (number 0 without parts if none is)."""
        p, fs = self._fs(f"{self.root}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return SnapshotVersion(0)
        text = self.spark.read.text(f"{self.root}/versions/{max(numbers)}", wholetext=True).first()[0]
        found = json.loads(text)
        return SnapshotVersion(**{**found, "parts": tuple(found["parts"])})

    def _publish(self, version: SnapshotVersion) -> None:
        p, fs = self._fs(f"{self.root}/versions/{version.number}")
        out = fs.create(p, False)  # fails if the version exists
        out.write(bytearray(json.dumps({**version.__dict__, "parts": list(version.parts)}).encode()))
        out.close()

    def lines(self, version: SnapshotVersion | None = None) -> DataFrame:
        """The clean lines of a version (the last one)."""
        version = version or self.current()
        if not version.parts:
            raise ValueError("nothing has been published")
        return self.spark.read.parquet(*version.parts).drop(SOURCE)

    # ----------------------------------------------------------------- load

    def source_files(self) -> DataFrame:
        """``path, size, modified`` of the folder's files, contents unread."""
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.folder)
        return listed.select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_modification_time").alias("modified"))

    def load(self) -> SnapshotVersion:
        """Bring the snapshot up to date and return its version."""
        before = self.current()
        same = ["path", "size", "modified"]
        now = self.spark.createDataFrame([], "path string, size bigint, modified timestamp")
        p, fs = self._fs(self.folder)
        if fs.exists(p) and fs.getContentSummary(p).getFileCount():
            now = self.source_files()
        known = self.spark.read.parquet(before.manifest) if before.manifest else now.limit(0).withColumn("part", F.lit(""))
        # The files of one load, as every reader's file list, reach the driver.
        fresh = now.join(known, same, "left_anti").collect()
        gone = known.join(now, same, "left_anti")
        touched = [r["part"] for r in gone.select("part").distinct().collect()]
        if not fresh and not touched:
            return before
        made: list[str] = []
        try:
            parts = [p for p in before.parts if p not in touched]
            figures: Mapping[str, int] = {}
            for part in touched:
                rest = self.spark.read.parquet(part).join(
                    gone.select(F.col("path").alias(SOURCE)).distinct(), SOURCE, "left_anti")
                made.append(self._write(rest))
                parts.append(made[-1])
                self._add_keys(made[-1])
            new_part = ""
            if fresh:
                figures, new_part = self._clean_files([r["path"] for r in fresh], made)
                self._check_key(new_part, parts)
                self._add_keys(new_part)
                parts.append(new_part)
            moved = dict(zip(touched, made))
            kept = known.join(now, same, "left_semi").select(*same, "part").replace(moved, subset=["part"]) \
                if moved else known.join(now, same, "left_semi").select(*same, "part")
            added = self.spark.createDataFrame([(*r, new_part) for r in fresh], "path string, size bigint, modified timestamp, part string")
            manifest = self._new("manifests")
            made.append(manifest)
            write_table(kept.unionByName(added), manifest)
            version = SnapshotVersion(before.number + 1, tuple(parts), manifest, figures, len(fresh))
            self._publish(version)
        except Exception:
            for path in made:
                p, fs = self._fs(path)
                fs.delete(p, True)
            raise
        return version

    def _new(self, kind: str) -> str:
        return f"{self.root}/{kind}/{uuid.uuid4().hex}"

    def _write(self, df: DataFrame) -> str:
        path = self._new("parts")
        write_table(df, path)
        return path

    def _clean_files(self, paths: list[str], made: list[str]) -> tuple[Mapping[str, int], str]:
        # Listed as encoded URIs; readers take plain paths with glob signs.
        plain = [re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(p)) for p in paths]
        raw = self.read(self.spark, plain)
        load = Load(raw.select("*", F.col("_metadata.file_path").alias(SOURCE)), self.limits)
        made.append(self._new("parts"))
        write_table(load.written(clean(load.observed(), self.corrections, keep=[SOURCE])), made[-1])
        return load.check(self.spark.read.parquet(made[-1])), made[-1]

    def _keys(self, part: str) -> DataFrame:
        return self.spark.read.parquet(part).select(F.col(self.key).alias("key"))

    def _check_key(self, part: str, parts: Sequence[str]) -> None:
        if self.key is None:
            return
        bad = self.index.repeated(self._keys(part), parts).limit(3).collect()
        if bad:
            raise LoadRefused(f"{self.key} is NULL or repeated, e.g. {[r['key'] for r in bad]}")

    def _add_keys(self, part: str) -> None:
        if self.key is not None:
            self.index.add(self._keys(part), part)
