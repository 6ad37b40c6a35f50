"""Benchmark every registered query of the analysis.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` (default 8).  The raw and clean order-line tables
are built (written) once, as a pipeline would.  Then one pass runs every
query (its times are reported apart: it compiles code and writes the
intermediate tables that later calls reuse), followed by ``$BENCH_RUNS``
(default 3) timed passes over all queries in turn, each without the reused
intermediates of the pass before (a slow spell of the machine then hits one
pass of many queries, not every run of one query).  Each query is executed
in full into Spark's ``noop`` sink (no driver collect).  Prints one JSON
line: per-query median seconds, and as ``value`` their sum plus the build
times.  Queries that build tables load by load (``catalog.LOAD_KEYS``) run
only when ``$BENCH_ONLY`` names them.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from storeflow.plans import catalog  # noqa: E402
from storeflow.session import local_session  # noqa: E402
from storeflow.sources.raw import bronze_lines, name_corrections  # noqa: E402
from storeflow.sources.storage import forget_intermediates  # noqa: E402
from storeflow.sources.silver import silver_lines  # noqa: E402


def _run(builder, spark, sf_dir: str) -> float:
    t = time.perf_counter()
    builder(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = set(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))
    spark = local_session(cpus, shuffle_partitions=max(cpus, 8), app_name="storeflow-bench")

    build = {}
    for name, make in (("bronze_lines", bronze_lines), ("name_corrections", name_corrections),
                       ("silver_lines", silver_lines)):
        t = time.perf_counter()
        make(spark, sf_dir)
        build[name] = round(time.perf_counter() - t, 3)

    selected = {k: b for k, b in catalog.queries().items() if (k in only if only else k not in catalog.LOAD_KEYS)}
    # The first pass also writes the tables that queries reuse afterwards
    # (entity totals, buckets): its times are reported as "first".
    first = {name: round(_run(builder, spark, sf_dir), 4) for name, builder in selected.items()}
    samples: dict[str, list[float]] = {k: [] for k in selected}
    for _ in range(runs):
        forget_intermediates(spark)
        for name, builder in selected.items():
            samples[name].append(_run(builder, spark, sf_dir))
    timings = {k: round(statistics.median(v), 4) for k, v in samples.items()}

    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({
        "metric": "build_plus_sum_of_median_query_seconds",
        "value": round(sum(build.values()) + sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": sf,
        "build_sec": build,
        "query_sec": round(sum(timings.values()), 3),
        "first_pass_sec": round(sum(first.values()), 3),
        "first": first,
        "cpus": cpus,
        "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
