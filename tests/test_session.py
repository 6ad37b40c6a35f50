"""Session settings that written tables and exact results rest on."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from pyspark.sql import functions as F

from storeflow import session
from storeflow.plans.inspect import physical_plan
from storeflow.session import PARTITION_SOURCE_BYTES, check_settings, ensure_checkpoint_dir, spread_shuffles
from storeflow.sources.storage import named_table

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


class Conf(dict):
    """Stands in for a session's settings."""

    def get(self, key, default=None):
        return dict.get(self, key, default)

    def set(self, key, value):
        self[key] = value


class Session:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://https://x"])
def test_sessions_of_several_processes_need_the_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session(spark_master=master))


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4]"])
def test_local_sessions_get_a_folder_once(master):
    session = Session(spark_master=master)
    folder = ensure_checkpoint_dir(session)
    assert os.path.isdir(folder) and ensure_checkpoint_dir(session) == folder


def test_settings_that_are_off_are_refused():
    session = Session()
    session.conf["spark.sql.ansi.enabled"] = "false"
    with pytest.raises(ValueError, match="ansi"):
        check_settings(session)


def test_the_folder_of_the_session_is_read(spark):
    assert ensure_checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_entry_works_without_the_optional_subpackage():
    """Imports and keys when the llm parts are absent."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('storeflow.llm'):\n"
        "            raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.llm is None and set(e.queries()) == set(e.oracle_sql())\n"
        "print(len(e.queries()))\n")
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    from storeflow.plans import catalog

    assert int(run.stdout) == len(catalog.queries())


def test_shuffles_are_spread_with_the_files_and_settings_come_back(spark):
    shuffles, scans = "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"
    before = {name: spark.conf.get(name) for name in (shuffles, scans)}
    with pytest.raises(KeyError), spread_shuffles(spark, 100 * PARTITION_SOURCE_BYTES + 1):
        assert spark.conf.get(shuffles) == "101"
        keys = spark.range(10_000).groupBy((F.col("id") % 5000).alias("k")).count()
        assert ", 101)" in physical_plan(keys, "simple")
        raise KeyError
    assert {name: spark.conf.get(name) for name in before} == before
    with spread_shuffles(spark, 10):  # small files leave the session's number
        assert {name: spark.conf.get(name) for name in before} == before


def test_named_tables_are_written_with_spread_shuffles(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "source")
    spark.range(1000).write.parquet(source)
    monkeypatch.setattr(session, "PARTITION_SOURCE_BYTES", 100)
    seen = []

    def build():
        seen.append(int(spark.conf.get("spark.sql.shuffle.partitions")))
        return spark.read.parquet(source).groupBy("id").count()

    assert named_table(spark, "test/spread", build, sources=[source]).count() == 1000
    assert seen[0] > 8 == int(spark.conf.get("spark.sql.shuffle.partitions"))
