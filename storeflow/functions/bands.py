"""Threshold bands as one CASE expression.

A band rule is ``(op, bound, label)``; the first rule that holds wins and
``default`` is the ELSE branch.  A NULL input satisfies no rule and lands
in the default, as a SQL searched CASE does.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {
    "==": lambda c, b: c == b,
    "<": lambda c, b: c < b,
    "<=": lambda c, b: c <= b,
    ">": lambda c, b: c > b,
    ">=": lambda c, b: c >= b,
}

Rule = tuple[str, str | int | Decimal, str]


def _bound(b) -> Column:
    # Exact decimal literals: "0.20" compares as 0.20, never as a double.
    if isinstance(b, str):
        return F.lit(Decimal(b))
    return F.lit(b)


def band(col: Column | str, rules: Sequence[Rule], default: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for op, bound, label in rules:
        cond = _OPS[op](c, _bound(bound))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))
