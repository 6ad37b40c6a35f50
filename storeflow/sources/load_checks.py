"""What a load must satisfy before its table is published.

The figures of files that are costly to read again are taken while the table
is written: one observation on the raw lines and one on the cleaned ones
(``DataFrame.observe``), so they cost no pass over the data.  A figure can be
too high where a lost executor's map stage ran again; so a figure that breaks
a rule is counted once more, by a pass of its own, before the load is refused.

Where raw and clean lines both lie in columns, ``count`` counts them there:
two scans of the few columns that the figures read cost less than an
observation, which sees every column of every row.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schema import CRITICAL_RAW_COLUMNS


class LoadRefused(ValueError):
    """A load breaks a rule; the table published before stays."""


def raw_figures() -> dict[str, Column]:
    """Figures of raw lines, by name."""
    missing = None
    for c in CRITICAL_RAW_COLUMNS:
        null = F.col(f"`{c}`").isNull()
        missing = null if missing is None else missing | null
    return {"raw_rows": F.count(F.lit(1)), "missing_values": F.count_if(missing)}


def clean_figures() -> dict[str, Column]:
    """Figures of clean lines, by name."""
    return {
        "clean_rows": F.count(F.lit(1)),
        "shipped_before_ordered": F.count_if(F.col("ship_date") < F.col("order_date")),
        "negative_sales": F.count_if(F.col("sales") < 0),
        "invalid_quantity": F.count_if(F.col("quantity") <= 0),
        "loss_lines": F.count_if(F.col("profit") < 0),
        "missing_dates": F.count_if(F.col("order_date").isNull() | F.col("ship_date").isNull()),
    }


def _named(figures: Mapping[str, Column]) -> list[Column]:
    return [c.cast("bigint").alias(name) for name, c in figures.items()]


@dataclass
class Load:
    """A load under observation: ``observed(raw)`` is cleaned, ``written``
    is what goes to the table; ``figures`` are known once it was written."""

    raw: DataFrame
    limits: Mapping[str, int]

    def __post_init__(self):
        self._raw, self._clean = Observation(), Observation()
        unknown = set(self.limits) - {*raw_figures(), *clean_figures()}
        if unknown:
            raise ValueError(f"no such figures: {sorted(unknown)}")

    def observed(self) -> DataFrame:
        return self.raw.observe(self._raw, *_named(raw_figures()))

    def written(self, clean: DataFrame) -> DataFrame:
        return clean.observe(self._clean, *_named(clean_figures()))

    def figures(self) -> dict[str, int]:
        return {**self._raw.get, **self._clean.get}

    def check(self, table: DataFrame) -> dict[str, int]:
        """The load's figures; raises ``LoadRefused`` where rows were lost or
        added by cleaning, or a figure is above its limit."""
        found = self.figures()
        return self.count(table) if self._broken(found) else found

    def count(self, table: DataFrame) -> dict[str, int]:
        """As ``check``, with figures counted in the tables themselves."""
        found = {**self.raw.agg(*_named(raw_figures())).first().asDict(),
                 **table.agg(*_named(clean_figures())).first().asDict()}
        broken = self._broken(found)
        if broken:
            raise LoadRefused("; ".join(broken))
        return found

    def _broken(self, found: Mapping[str, int]) -> list[str]:
        out = []
        if found["raw_rows"] != found["clean_rows"]:
            out.append(f"{found['raw_rows']} raw rows became {found['clean_rows']}")
        return out + [f"{name}: {found[name]}, at most {most} allowed"
                      for name, most in self.limits.items() if found[name] > most]


def figures_table(spark: SparkSession, figures: Mapping[str, int]) -> DataFrame:
    """``figure, rows``: one row per figure of a load."""
    return spark.createDataFrame(sorted(figures.items()), "figure string, rows bigint")
