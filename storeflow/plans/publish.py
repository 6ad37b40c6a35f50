"""Write query results as tables (the CREATE TABLE AS of the analyses).

python -m storeflow.plans.publish <sf_dir> <out_dir> [key ...]

Each key is written to ``<out_dir>/<key>`` as Parquet with
``mode("overwrite")`` (drop-if-exists), executed on the cluster; nothing
passes through the driver.  The one-dimensional breakdowns among the keys
share one scan of the clean lines (``operators.breakdowns``); the others
take one query each.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from ..operators.breakdowns import KEYS, breakdown, measures
from ..session import local_session
from ..sources.silver import silver_lines
from ..sources.storage import materialize
from . import catalog


def publish(spark: SparkSession, sf_dir: str, out_dir: str, keys=None) -> dict[str, str]:
    """Write every selected key; returns key -> path."""
    builders = catalog.queries()
    keys = list(keys or builders)
    shared = None
    if any(key in KEYS for key in keys):
        shared = materialize(measures(silver_lines(spark, sf_dir)), "measures")
    written = {}
    for key in keys:
        path = os.path.join(out_dir, key)
        result = breakdown(shared, key) if key in KEYS else builders[key](spark, sf_dir)
        result.write.mode("overwrite").parquet(path)
        written[key] = path
    return written


def main(argv: list[str]) -> None:
    sf_dir, out_dir, *keys = argv
    spark = local_session()
    for key, path in publish(spark, sf_dir, out_dir, keys or None).items():
        print(key, path)


if __name__ == "__main__":
    main(sys.argv[1:])
