"""Global ordered scans without moving every row to one task.

``RANK``, ``ROW_NUMBER``, ``NTILE`` and ``SUM() OVER (ORDER BY ...)`` with
no ``PARTITION BY`` plan in Spark as one window over a single partition.
Here the same results come from range buckets, by one path at every size:

1. The input (one row per entity, e.g. per customer) is written once and
   counted.  Bucket count B = the larger of the session's parallelism and
   ceil(n / rows_per_bucket).
2. The table is range-partitioned into B partitions on (prefix, order,
   tie-break) -- Spark samples the keys and assigns each row by binary
   search over the bounds -- sorted inside each, and written once together
   with its partition id (bucket) and its place in the bucket.  From then
   on both are data: retries, AQE and later reads cannot move a row.  The
   key includes the tie-break, so a value shared by a third of all rows is
   still spread over many buckets.
3. Per (prefix, bucket): count, first place and sums, turned into exclusive
   offsets by a window over at most B rows per prefix, written, and joined
   back (the planner knows the written table's size and picks the join).
4. Position = offset + place, without a second exchange.  Running sums add
   an ordinary window partitioned by (prefix, bucket).

``rank`` and the RANGE running sum depend on peers (rows with equal sort
values), which a bucket edge may cut.  Ranks and sums are first taken inside
the bucket.  The per-bucket table also holds the values at both ends of each
bucket; over that small table a peer group that begins in an earlier bucket
hands its first place on to the next ones, and one that ends in a later
bucket its sum back.  Only rows of a bucket's first (rank) or last (sum) peer
group take the corrected figure, so nothing is joined on the sort value, and
a value held by half of all rows is spread over buckets like any other.

NTILE needs a few positions only: ``selection.ntiles`` finds them by
counting, without this scan.

Sums are exact (decimal), so the results are exactly those of the plain
single-partition window; the tests hold them to equality.  The functions
here run jobs (counts and writes) while the frame is built.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import parallelism
from ..sources.storage import materialize

ROWS_PER_BUCKET = 1_000_000


@dataclass(frozen=True)
class SortKey:
    """One ORDER BY item.  ``nulls_first=None`` is PostgreSQL's default:
    nulls first when descending, last when ascending."""

    col: str
    descending: bool = False
    nulls_first: bool | None = None

    @property
    def nf(self) -> bool:
        return self.descending if self.nulls_first is None else self.nulls_first

    def sort_col(self) -> Column:
        c = F.col(self.col)
        if self.descending:
            return c.desc_nulls_first() if self.nf else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nf else c.asc_nulls_last()


def desc(col: str) -> SortKey:
    return SortKey(col, True)


def asc(col: str) -> SortKey:
    return SortKey(col, False)


def _keys(order: Sequence[SortKey | str]) -> list[SortKey]:
    return [k if isinstance(k, SortKey) else asc(k) for k in order]


def bucket_count(df: DataFrame, n: int, rows_per_bucket: int) -> int:
    return max(parallelism(df.sparkSession), math.ceil(n / max(rows_per_bucket, 1)))


def _null_safe_join(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``cols`` treating NULL = NULL; keeps the left copies.
    Never a cross join: at least one key is required."""
    if not cols:
        raise ValueError("a join key is required")
    ren = right.select(*[F.col(c).alias(f"__r_{c}") if c in cols else F.col(c)
                         for c in right.columns])
    cond = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in cols]
    joined = left.join(ren, cond, how)
    return joined.drop(*[f"__r_{c}" for c in cols])


def range_buckets(df: DataFrame, sort_cols: Sequence[Column], buckets: int) -> DataFrame:
    """``df`` range-partitioned into ``buckets`` on ``sort_cols`` and sorted,
    written with the bucket ``_b`` (bucket order = sort order) and the
    0-based place ``_i`` in it."""
    ranged = df.repartitionByRange(buckets, *sort_cols).sortWithinPartitions(*sort_cols)
    # The id holds the partition in its upper and the place in its lower bits.
    tagged = ranged.withColumn("_id", F.monotonically_increasing_id())
    return materialize(
        tagged.withColumn("_b", F.shiftright("_id", 33).cast("int"))
        .withColumn("_i", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"),
        "buckets")


# ---------------------------------------------------------------- the scan


def scan(
    df: DataFrame,
    order: Sequence[SortKey | str],
    tie_break: Sequence[str] = (),
    prefix: Sequence[str] = (),
    sums: Sequence[str] = (),
    with_total: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``_rn`` (1-based position in the order within ``prefix``), for
    every column c in ``sums`` the inclusive running sum ``_run_<c>`` and
    the running count of non-null values ``_nn_<c>``, and with
    ``with_total`` the row count ``_n`` of the prefix group.

    The order is ``order`` then ``tie_break`` (ascending); rows equal on
    both are numbered in an arbitrary but consistent way.
    """
    keys = _keys(order) + [asc(c) for c in tie_break]
    prefix = list(prefix)
    df = materialize(df, "ordered")
    sort_cols = [F.col(p).asc_nulls_first() for p in prefix] + [k.sort_col() for k in keys]
    rows = range_buckets(df, sort_cols, bucket_count(df, df.count(), rows_per_bucket))

    stat_aggs = [F.count(F.lit(1)).alias("_bn"), F.min("_i").alias("_first")]
    for c in sums:
        stat_aggs += [F.sum(c).alias(f"_bs_{c}"), F.count(c).alias(f"_bc_{c}")]
    stats = rows.groupBy(*prefix, "_b").agg(*stat_aggs)
    wb = Window.partitionBy(*prefix).orderBy("_b")
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    offs = [(F.coalesce(F.sum("_bn").over(before), F.lit(0)) - F.col("_first")).alias("_off_n")]
    for c in sums:
        offs += [
            F.sum(f"_bs_{c}").over(before).alias(f"_off_s_{c}"),
            F.coalesce(F.sum(f"_bc_{c}").over(before), F.lit(0)).alias(f"_off_c_{c}"),
        ]
    if with_total:
        offs.append(F.sum("_bn").over(Window.partitionBy(*prefix)).alias("_n"))
    stats = materialize(stats.select(*prefix, "_b", *offs), "bucket-stats")
    out = _null_safe_join(rows, stats, [*prefix, "_b"])
    out = out.withColumn("_rn", (F.col("_off_n") + F.col("_i") + 1).cast("bigint"))

    w_run = Window.partitionBy(*prefix, "_b").orderBy("_i").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    for c in sums:
        nn = F.col(f"_off_c_{c}") + F.count(c).over(w_run)
        total = F.coalesce(F.col(f"_off_s_{c}"), F.lit(0)) + F.coalesce(F.sum(c).over(w_run), F.lit(0))
        out = out.withColumn(f"_nn_{c}", nn).withColumn(
            f"_run_{c}", F.when(F.col(f"_nn_{c}") > 0, total)
        )
        out = out.drop(f"_off_s_{c}", f"_off_c_{c}")
    return out.drop("_b", "_i", "_off_n")


# ------------------------------------------------------------ public forms


def row_number(df: DataFrame, order, tie_break=(), prefix=(), out="row_number", **kw) -> DataFrame:
    res = scan(df, order, tie_break, prefix, **kw)
    return res.withColumnRenamed("_rn", out)


def ntile_expr(rn: Column, n: Column, k: Column | int) -> Column:
    """NTILE(k) from a 1-based row number and the group size: the first
    ``n mod k`` tiles get one row more."""
    q = F.floor(n / k).cast("bigint")
    r = (n % k).cast("bigint")
    big = r * (q + 1)
    return F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1).otherwise(
        r + F.floor((rn - 1 - big) / q) + 1
    ).cast("bigint")


def ntile(df: DataFrame, k: int, order, tie_break=(), prefix=(), out="ntile", **kw) -> DataFrame:
    res = scan(df, order, tie_break, prefix, with_total=True, **kw)
    return res.withColumn(out, ntile_expr(F.col("_rn"), F.col("_n"), k)).drop("_rn", "_n")


def _tie(df: DataFrame, tie_break: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rows of one value need an order among themselves to be spread over
    buckets: that of the given columns, else of a hash of the whole row."""
    if tie_break:
        return df, list(tie_break)
    return df.withColumn("_tie", F.xxhash64(*df.columns)), ["_tie"]


def _with_peers(df: DataFrame, order, prefix: Sequence[str], value: str | None, tie_break: Sequence[str],
                rows_per_bucket: int) -> DataFrame:
    """``df`` with ``_rank``, or with ``value`` its RANGE running sum
    ``_cum`` (NULL while all values are NULL)."""
    keys, prefix = _keys(order), list(prefix)
    df, tie = _tie(materialize(df, "ordered"), tie_break)
    sort_cols = [F.col(p).asc_nulls_first() for p in prefix] + [k.sort_col() for k in keys]
    buckets = bucket_count(df, df.count(), rows_per_bucket)
    rows = range_buckets(df, sort_cols + [F.col(t).asc_nulls_first() for t in tie], buckets)

    # Per bucket: its rows, the value at either end, the groups there.
    cols = [k.col for k in keys]
    measured = [F.sum(value).alias("s"), F.count(value).alias("c")] if value else []
    groups = rows.groupBy(*prefix, "_b", *cols).agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("lo"), *measured)
    at = F.struct(*cols)
    ends = [F.sum("n").alias("_bn"), F.min("lo").alias("first"), F.max("lo").alias("tail"), F.count(F.lit(1)).alias("groups"),
            F.min_by(at, "lo").alias("head_value"), F.max_by(at, "lo").alias("tail_value")]
    for c in ("s", "c") if value else ():
        ends += [F.sum(c).alias(f"b{c}"), F.min_by(c, "lo").alias(f"head_{c}")]
    per = Window.partitionBy(*prefix).orderBy("_b")
    before, after = per.rowsBetween(Window.unboundedPreceding, -1), per.rowsBetween(1, Window.unboundedFollowing)
    zero = F.lit(0)
    stats = groups.groupBy(*prefix, "_b").agg(*ends).select(
        "*", F.coalesce(F.sum("_bn").over(before), zero).alias("_off_n"),
        F.col("head_value").eqNullSafe(F.lag("tail_value").over(per)).alias("from_before"),
        F.coalesce(F.lead("head_value").over(per).eqNullSafe(F.col("tail_value")), F.lit(False)).alias("goes_on"),
        *[F.coalesce(F.sum(f"b{c}").over(before), zero).alias(f"_off_{c}") for c in (("s", "c") if value else ())])
    # Where the last group of a bucket begins, and the sum up to the end of
    # its first; NULL in a bucket that such a group fills from edge to edge.
    begins = F.when(~((F.col("groups") == 1) & F.col("from_before")), F.col("_off_n") + F.col("tail") - F.col("first"))
    stats = stats.withColumn("begins", begins)
    out = [F.when(F.col("from_before"), F.last("begins", ignorenulls=True).over(before)).otherwise(F.col("_off_n")).alias("_head_n")]
    for c in ("s", "c") if value else ():
        open_end = (F.col("groups") == 1) & F.col("goes_on")
        stats = stats.withColumn(f"until_{c}", F.when(~open_end, F.col(f"_off_{c}") + F.coalesce(f"head_{c}", zero)))
        out.append(F.when(F.col("goes_on"), F.first(f"until_{c}", ignorenulls=True).over(after))
                   .otherwise(F.col(f"_off_{c}") + F.coalesce(f"b{c}", zero)).alias(f"_tail_{c}"))
        out.append(F.col(f"_off_{c}"))
    stats = materialize(stats.select(*prefix, "_b", "_bn", "_off_n", *out), "bucket-stats")

    res = _null_safe_join(rows, stats, [*prefix, "_b"])
    inside = Window.partitionBy(*prefix, "_b").orderBy(*[k.sort_col() for k in keys])
    if value is None:
        local = F.rank().over(inside)
        res = res.withColumn("_rank", (F.when(local == 1, F.col("_head_n")).otherwise(
            F.col("_off_n") + local - 1) + 1).cast("bigint"))
    else:
        last = F.count(F.lit(1)).over(inside) == F.col("_bn")
        total = F.when(last, F.col("_tail_s")).otherwise(F.col("_off_s") + F.coalesce(F.sum(value).over(inside), zero))
        seen = F.when(last, F.col("_tail_c")).otherwise(F.col("_off_c") + F.count(value).over(inside))
        res = res.withColumn("_cum", F.when(seen > 0, total))
    return res.drop("_b", "_i", "_bn", "_off_n", "_off_s", "_off_c", "_head_n", "_tail_s", "_tail_c", "_tie")


def rank(df: DataFrame, order, prefix=(), out="rank", tie_break=(), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``RANK() OVER ([PARTITION BY prefix] ORDER BY order)``.
    ``tie_break`` only spreads rows of one value over buckets."""
    return _with_peers(df, order, prefix, None, tie_break, rows_per_bucket).withColumnRenamed("_rank", out)


def cumulative_sum(df: DataFrame, value: str, order, prefix=(), out="cumulative", tie_break=(),
                   rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``SUM(value) OVER ([PARTITION BY prefix] ORDER BY order)`` (RANGE frame)."""
    return _with_peers(df, order, prefix, value, tie_break, rows_per_bucket).withColumnRenamed("_cum", out)


# ------------------------------------------------- plain forms (reference)


def plain_window(order, tie_break=(), prefix=()) -> Window:
    keys = _keys(order) + [asc(c) for c in tie_break]
    return Window.partitionBy(*prefix).orderBy(*[k.sort_col() for k in keys])
