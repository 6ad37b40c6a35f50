"""Plan inspection helpers (text of ``explain``)."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame, mode: str = "formatted") -> str:
    """The text ``df.explain(mode)`` prints."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def executed_plan(df: DataFrame) -> str:
    """Run ``df`` once and give the plan that ran (AQE's final one)."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return execution.executedPlan().toString()


def single_partition_inputs(plan: str) -> list[list[str]]:
    """Column names entering every ``Exchange SinglePartition`` of a
    formatted plan (one list per exchange)."""
    blocks = plan.split("\n\n")
    out = []
    for block in blocks:
        lines = block.strip().splitlines()
        if not lines or "Exchange" not in lines[0]:
            continue
        if not any("SinglePartition" in ln for ln in lines):
            continue
        inputs = next((ln for ln in lines if ln.startswith("Input")), "")
        names = inputs.split(":", 1)[1].strip().strip("[]") if ":" in inputs else ""
        out.append([n.strip().split("#")[0] for n in names.split(",") if n.strip()])
    return out
