"""Validation of order lines: counts, nulls, duplicates, keys, rules.

Row listings (``bad_ship_dates`` ...) are filters without a shuffle;
single-column comparisons reach the Parquet scan as pushed filters.
Counts are one aggregation pass each (``count_if``), and the quality
summary computes every rule in a single pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_replacement_char
from ..schema import CRITICAL_RAW_COLUMNS, RAW_TO_CLEAN
from ..sources.storage import materialize
from .aggregates import asc, desc, distinct_count, summarize
from .clean import DATE_PATTERN, parse_date


def _q(name: str):
    return F.col(f"`{name}`")


def schema_report(df: DataFrame) -> DataFrame:
    """(column_name, data_type) of ``df`` -- the catalog listing."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, data_type string")


def row_count(df: DataFrame, alias: str = "total_rows") -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("bigint").alias(alias))


def null_audit(raw: DataFrame, cols: Sequence[str] = CRITICAL_RAW_COLUMNS) -> DataFrame:
    """NULL count of each column, one pass; named ``<clean name>_nulls``."""
    return raw.agg(*[
        F.count_if(_q(c).isNull()).cast("bigint").alias(f"{RAW_TO_CLEAN.get(c, c)}_nulls")
        for c in cols
    ])


def row_hash(cols: Sequence[str]) -> Column:
    """64 bits of a row; which columns are NULL counts too."""
    nulls = F.concat(*[F.when(_q(c).isNull(), "1").otherwise("0") for c in cols])
    return F.xxhash64(*[_q(c) for c in cols], nulls)


def row_digest(cols: Sequence[str]) -> tuple[Column, Column]:
    """128 bits of a row, independent of ``row_hash``: the halves of the MD5
    of its JSON (field names keep values and NULLs apart)."""
    md5 = F.md5(F.to_json(F.struct(*[_q(c) for c in cols])).cast("binary"))
    return tuple(F.conv(F.substring(md5, start, 16), 16, -10).cast("long") for start in (1, 17))


def agreement(df: DataFrame, cols: Sequence[str], hash_of: Callable[[Sequence[str]], Column] = row_hash) -> DataFrame:
    """What the groups of equal row hashes say about repeated rows, one
    narrow row (hash and digest) shuffled per input row at most.

    A group whose digests all agree (least = greatest, in both halves) holds
    copies of one row.  Result: one row with ``h`` NULL and the ``extra`` rows
    of all such groups, and one row per group that disagrees.
    """
    d0, d1 = row_digest(cols)
    narrow = df.select(hash_of(cols).alias("h"), d0.alias("d0"), d1.alias("d1"))
    groups = narrow.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"),
        *[f(d).alias(f"{name}_{d}") for d in ("d0", "d1") for name, f in (("min", F.min), ("max", F.max))])
    agree = (F.col("min_d0") == F.col("max_d0")) & (F.col("min_d1") == F.col("max_d1"))
    return groups.where("n > 1").groupBy(F.when(~agree, F.col("h")).alias("h")).agg(F.sum(F.col("n") - 1).alias("extra"))


def full_duplicate_count(df: DataFrame, cols: Sequence[str] | None = None,
                         hash_of: Callable[[Sequence[str]], Column] = row_hash) -> DataFrame:
    """Rows beyond the first of every group of identical rows (NULLs equal).

    Grouping on all columns would shuffle whole rows.  Instead an agreement
    aggregate (see ``agreement``) shuffles a hash and a digest per row,
    whatever share of the rows repeats, and is written (the job runs while
    the frame is built).  Only rows of groups that disagree -- different rows
    with one 64-bit hash, or rows whose equal values print unlike -- are
    compared in full.  Rows that agree in all 192 bits count as equal.
    """
    cols = list(cols or df.columns)
    found = materialize(agreement(df, cols, hash_of), "agreement")
    sure = found.where("h IS NULL").select("extra")
    unlike = found.where("h IS NOT NULL").select("h")
    if not unlike.isEmpty():
        qc = [_q(c) for c in cols]
        rows = df.select(*qc, hash_of(cols).alias("__h")).join(unlike.withColumnRenamed("h", "__h"), "__h", "left_semi")
        groups = rows.groupBy(*qc).agg(F.count(F.lit(1)).alias("__n"))
        sure = sure.unionByName(groups.select((F.col("__n") - 1).alias("extra")))
    return sure.agg(F.coalesce(F.sum("extra"), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def duplicate_keys(df: DataFrame, key: Sequence[str] = ("row_id",)) -> DataFrame:
    """Key values that occur more than once, with their count."""
    key = list(key)
    return df.groupBy(*key).agg(F.count(F.lit(1)).cast("bigint").alias("duplicate_count")).where(
        F.col("duplicate_count") > 1
    )


def assert_key(df: DataFrame, key: Sequence[str] = ("row_id",)) -> None:
    """Raise unless ``key`` is unique and never NULL (a primary key).

    One pass that shuffles 64-bit hashes clears a key: equal keys have equal
    hashes.  Only where it finds a NULL or a hash twice are the keys
    themselves counted."""
    key = list(key)
    any_null = F.col(key[0]).isNull()
    for k in key[1:]:
        any_null = any_null | F.col(k).isNull()
    hashes = df.groupBy(F.xxhash64(*key).alias("_hash")).agg(
        F.count(F.lit(1)).alias("_times"), F.max(any_null).alias("_null"))
    if not hashes.where((F.col("_times") > 1) | F.col("_null")).limit(1).count():
        return
    nulls = df.where(any_null).limit(1).count()
    dups = duplicate_keys(df, key).limit(1).count()
    if nulls or dups:
        raise ValueError(f"key {key} is not a primary key: nulls={bool(nulls)} duplicates={bool(dups)}")


def sample_rows(df: DataFrame, n: int = 5, cols=("order_date", "ship_date"),
                order=("row_id",)) -> DataFrame:
    """``n`` rows of ``cols``, the first by ``order`` (a repeatable LIMIT)."""
    return df.orderBy(*[asc(c) for c in order]).select(*cols).limit(n) if order else \
        df.select(*cols).limit(n)


def corrupt_name_report(df: DataFrame, col: str = "customer_name") -> DataFrame:
    """Names holding U+FFFD with their row counts, most frequent first."""
    return df.where(has_replacement_char(F.col(col))).groupBy(col).agg(
        F.count(F.lit(1)).cast("bigint").alias("records_count")
    ).orderBy(desc("records_count"), asc(col))


def bad_ship_dates(sl: DataFrame) -> DataFrame:
    return sl.where(F.col("ship_date") < F.col("order_date"))


def negative_sales(sl: DataFrame) -> DataFrame:
    return sl.where(F.col("sales") < 0)


def bad_quantity(sl: DataFrame) -> DataFrame:
    return sl.where(F.col("quantity") <= 0)


def loss_lines(sl: DataFrame) -> DataFrame:
    return sl.where(F.col("profit") < 0)


def discount_levels(sl: DataFrame) -> DataFrame:
    return sl.select("discount").distinct().orderBy(asc("discount"))


def value_ranges(sl: DataFrame) -> DataFrame:
    return sl.agg(
        F.min("sales").cast("decimal(18,2)").alias("min_sales"),
        F.max("sales").cast("decimal(18,2)").alias("max_sales"),
        F.min("profit").cast("decimal(18,2)").alias("min_profit"),
        F.max("profit").cast("decimal(18,2)").alias("max_profit"),
    )


def date_span(sl: DataFrame) -> DataFrame:
    return sl.agg(F.min("order_date").alias("first_order_date"),
                  F.max("order_date").alias("last_order_date"))


def entity_counts(sl: DataFrame, exact: bool = True) -> DataFrame:
    return summarize(sl, [], [
        distinct_count("order_id", "total_orders", exact),
        distinct_count("customer_id", "total_customers", exact),
        distinct_count("product_id", "total_products", exact),
    ])


def invalid_dates(raw: DataFrame, cols=("Order Date", "Ship Date"),
                  pattern: str = DATE_PATTERN) -> DataFrame:
    """Raw rows whose date text is present but does not parse (quarantine)."""
    bad = None
    for c in cols:
        cond = _q(c).isNotNull() & parse_date(_q(c), pattern, strict=False).isNull()
        bad = cond if bad is None else (bad | cond)
    return raw.where(bad)


def quality_summary(raw: DataFrame, pattern: str = DATE_PATTERN) -> DataFrame:
    """One row per rule with the number of violating rows, one pass over
    the raw lines (plus the duplicate check):

    rows, missing_values (a critical column NULL), duplicate_rows,
    invalid_dates, shipped_before_ordered, negative_sales, invalid_quantity.
    """
    any_null = None
    for c in CRITICAL_RAW_COLUMNS:
        cond = _q(c).isNull()
        any_null = cond if any_null is None else (any_null | cond)
    # Parse each date once per row, then count every rule in one pass.
    parsed = raw.select(
        any_null.alias("_null"),
        _q("Order Date").isNotNull().alias("_has_od"),
        _q("Ship Date").isNotNull().alias("_has_sd"),
        parse_date(_q("Order Date"), pattern, strict=False).alias("_od"),
        parse_date(_q("Ship Date"), pattern, strict=False).alias("_sd"),
        _q("Sales").cast("decimal(12,2)").alias("_sales"),
        _q("Quantity").alias("_qty"),
    )
    od, sd = F.col("_od"), F.col("_sd")
    bad_date = (F.col("_has_od") & od.isNull()) | (F.col("_has_sd") & sd.isNull())
    one = parsed.agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"),
        F.count_if(F.col("_null")).cast("bigint").alias("missing_values"),
        F.count_if(bad_date).cast("bigint").alias("invalid_dates"),
        F.count_if(sd < od).cast("bigint").alias("shipped_before_ordered"),
        F.count_if(F.col("_sales") < 0).cast("bigint").alias("negative_sales"),
        F.count_if(F.col("_qty") <= 0).cast("bigint").alias("invalid_quantity"),
    )
    # The duplicate count is one value: a scalar subquery, not a join.
    wide = one.withColumn("duplicate_rows", full_duplicate_count(raw).scalar())
    names = ["rows", "missing_values", "duplicate_rows", "invalid_dates",
             "shipped_before_ordered", "negative_sales", "invalid_quantity"]
    return wide.unpivot([], names, "check", "violations")
