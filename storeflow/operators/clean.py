"""Cleaning: raw order lines -> clean order lines, in one projection.

The source script renames, retypes and repairs the table with fifteen
in-place statements; here they are one lazy ``select`` (written once by
the caller), so the table is read and written a single time.

* names: the 21 display names become snake_case;
* dates: ``M/d/yyyy`` text -> date; unparseable text fails the step, or
  with ``strict_dates=False`` becomes NULL (``quality.invalid_dates`` lists
  those rows, to be set aside first);
* money: ``decimal(12,2)``, discount ``decimal(4,2)``; the cast rounds
  half away from zero and raises on overflow (ANSI);
* postal code: text of at most 10 characters, longer codes fail (no zero
  padding unless ``pad_postal_code``);
* product names: U+FFFD -> space, whitespace runs -> one space, trim;
* customer names: exact-match corrections from a dictionary; two
  replacements for one spelling fail.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import repair_text
from ..schema import CLEAN_TYPES, POSTAL_CODE_MAX_LEN, RAW_TO_CLEAN

DATE_PATTERN = "M/d/yyyy"

# The name corrections of the source data set (wrong, right).
DEFAULT_NAME_CORRECTIONS = [
    ("Peter B�hler", "Peter Bühler"),
    ("Anna H�berlin", "Anna Häberlin"),
    ("Resi P�lking", "Resi Pülking"),
    ("Barry Franz�sisch", "Barry Französisch"),
    ("Roy Franz�sisch", "Roy Französisch"),
    ("Neil Franz�sisch", "Neil Französisch"),
]


def rename(raw: DataFrame) -> DataFrame:
    return raw.select(*[F.col(f"`{src}`").alias(dst) for src, dst in RAW_TO_CLEAN.items()])


def parse_date(c: Column, pattern: str = DATE_PATTERN, strict: bool = True) -> Column:
    """Date text -> date.  Unparseable text fails the job on the first such
    row, or without ``strict`` gives NULL (no extra pass either way)."""
    parsed = F.try_to_date(c.cast("string"), pattern)
    if not strict:
        return parsed
    bad = F.raise_error(F.concat(F.lit("unparseable date: "), c.cast("string"))).cast("date")
    return F.coalesce(parsed, F.when(c.isNotNull(), bad))  # the text is parsed once


def _typed(name: str, c: Column, dtype, pattern: str, pad_postal_code: int | None,
           strict_dates: bool = True) -> Column:
    if name in ("order_date", "ship_date"):
        return parse_date(c, pattern, strict_dates)
    if name == "postal_code":
        text = c.cast("string")
        text = F.lpad(text, pad_postal_code, "0") if pad_postal_code else text
        long = F.raise_error(F.concat(F.lit("postal code too long: "), text)).cast("string")
        return F.when(F.length(text) > POSTAL_CODE_MAX_LEN, long).otherwise(text)
    return c.cast(dtype)


def corrections_frame(spark, pairs=None) -> DataFrame:
    pairs = DEFAULT_NAME_CORRECTIONS if pairs is None else pairs
    return spark.createDataFrame(list(pairs), "wrong string, right string")


def fix_names(df: DataFrame, corrections: DataFrame, col: str = "customer_name") -> DataFrame:
    """Replace exact matches of ``corrections.wrong`` in ``col`` by ``right``.

    A left join on the name, its kind left to the planner.  The dictionary
    is reduced to one rule per wrong spelling first, so the join can never
    duplicate a line; two different replacements for one spelling raise.
    """
    d = corrections.groupBy(F.col("wrong").alias("_wrong")).agg(
        F.min("right").alias("_right"), F.max("right").alias("_other"))
    clash = F.raise_error(F.concat(F.lit("two replacements for: "), F.col("_wrong"))).cast("string")
    d = d.select("_wrong", F.when(F.col("_right") != F.col("_other"), clash)
                 .otherwise(F.col("_right")).alias("_right"))
    joined = df.join(d, F.col(col) == F.col("_wrong"), "left")
    return joined.select(
        *[F.coalesce(F.col("_right"), F.col(c)).alias(c) if c == col else F.col(c)
          for c in df.columns]
    )


def clean(raw: DataFrame, corrections: DataFrame | None = None, pattern: str = DATE_PATTERN,
          pad_postal_code: int | None = None, unicode_spaces: bool = False,
          strict_dates: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Raw order lines -> clean order lines (same rows, same order), with
    the further columns ``keep`` as they are.

    Date text that does not parse fails; with ``strict_dates=False`` it
    becomes NULL and ``quality.invalid_dates`` lists those rows."""
    renamed = raw.select(*[F.col(f"`{src}`").alias(dst) for src, dst in RAW_TO_CLEAN.items()], *keep)
    cols = []
    for name in renamed.columns:
        c = F.col(name)
        if name in CLEAN_TYPES:
            c = _typed(name, c, CLEAN_TYPES[name], pattern, pad_postal_code, strict_dates)
        if name == "product_name":
            c = repair_text(c, unicode_spaces=unicode_spaces)
        cols.append(c.alias(name))
    typed = renamed.select(*cols)
    if corrections is None:
        corrections = corrections_frame(raw.sparkSession)
    return fix_names(typed, corrections)


def clean_product_names(raw: DataFrame) -> DataFrame:
    """Distinct (product_id, repaired product_name) pairs."""
    return raw.select(
        F.col("`Product ID`").alias("product_id"),
        repair_text(F.col("`Product Name`")).alias("product_name"),
    ).distinct()


def fixed_customer_names(raw: DataFrame, corrections: DataFrame) -> DataFrame:
    """Distinct (customer_id, corrected customer_name) pairs."""
    names = raw.select(
        F.col("`Customer ID`").alias("customer_id"), F.col("`Customer Name`").alias("customer_name")
    ).distinct()
    return fix_names(names, corrections)
