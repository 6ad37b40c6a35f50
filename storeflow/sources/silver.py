"""The clean order lines: what every analysis reads.

``silver_lines`` is the cleaning step's output over the raw snapshot,
written once per application and folder and again when a source file has
changed.  It is published only after the load's checks (``load_checks``:
the figures are counted in the raw and the written lines) and its primary key.
``audit_clean_lines`` is the same step over the audit table, where dates
that do not parse become NULL instead of failing the step; it is written
once too, so that filters reach its scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..operators.clean import clean
from ..operators.quality import assert_key
from .load_checks import Load, figures_table
from .raw import audit_lines, bronze_lines, folder_tag, name_corrections
from .storage import Version, named_version
from .tables import line_sources


def _cleaned(spark: SparkSession, sf_dir: str, name: str, raw: DataFrame, limits: Mapping[str, int],
             key: list[str] | None, **options) -> Version:
    load = Load(raw, limits)

    def build() -> DataFrame:
        return clean(raw, name_corrections(spark, sf_dir), **options)

    def check(table: DataFrame) -> dict[str, int]:
        figures = load.count(table)
        if key:
            assert_key(table, key)
        return figures

    return named_version(spark, f"{name}-{folder_tag(sf_dir)}", build, check, line_sources(sf_dir))


def silver_version(spark: SparkSession, sf_dir: str, limits: Mapping[str, int] | None = None) -> Version:
    """The published table with its figures; ``limits`` are the most rows
    that may break a rule, by figure."""
    return _cleaned(spark, sf_dir, "silver/sales_lines", bronze_lines(spark, sf_dir), limits or {}, ["row_id"])


def silver_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver_version(spark, sf_dir).table


def audit_version(spark: SparkSession, sf_dir: str) -> Version:
    return _cleaned(spark, sf_dir, "silver/audit_lines", audit_lines(spark, sf_dir), {}, None, strict_dates=False)


def audit_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_version(spark, sf_dir).table


def load_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of the load that cleaned the audit lines."""
    return figures_table(spark, audit_version(spark, sf_dir).facts)
