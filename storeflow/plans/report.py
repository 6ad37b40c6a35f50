"""Physical plans of registered queries, for review.

python -m storeflow.plans.report [sf_dir] [key ...]  -> prints, per key,
the plan that one execution ended with (AQE's final plan).
"""

from __future__ import annotations

import sys

from ..session import local_session
from . import catalog
from .inspect import executed_plan


def plan_text(spark, sf_dir: str, key: str) -> str:
    return executed_plan(catalog.queries()[key](spark, sf_dir))


def main(argv: list[str]) -> None:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    keys = argv[1:] or list(catalog.queries())
    spark = local_session()
    for key in keys:
        print(f"### {key}\n\n```\n{plan_text(spark, sf_dir, key).strip()}\n```\n")


if __name__ == "__main__":
    main(sys.argv[1:])
