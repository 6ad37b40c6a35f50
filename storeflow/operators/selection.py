"""Distributed selection: cut values and rank limits without a sort.

A value's place in an order is found by counting, not by sorting: the range
of a ``long`` is divided into ``BINS`` equal bins, one pass counts (and
sums) the rows per bin, the bin that holds the place sought is divided
again, and so on.  A pass moves at most ``BINS`` partial rows per task and
search; a ``long`` needs at most six passes (64 / 12 bits), money and day
counts two or three.  The per-bin rows that reach the driver are bounded by
``BINS`` per search.

* ``share_cuts``: the smallest value down to which the values, largest
  first, make up a share of their sum (ABC classes, Pareto).
* ``rank_limits``: the rows at given positions of an order with a unique
  key as tie-break, all orders and positions in common passes (NTILE).

Rows are read from a written table (the caller's), every pass anew: what a
lost executor had counted is counted again.  The functions run jobs while
the frame is built; what they find is remembered with the table's frame, so
asking again counts nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal
from typing import Any
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 1 << 12
CHARS = 7  # bytes of a string per digit: an order-preserving number below 2^56


# Small results by the frame of the written table that they were found in.
_FOUND: WeakKeyDictionary[DataFrame, dict] = WeakKeyDictionary()


def _remembered(table: DataFrame, question: tuple, count: Callable[[], Any]) -> Any:
    known = _FOUND.setdefault(table, {})
    if question not in known:
        known[question] = count()
    return known[question]


# ------------------------------------------------------------- share cuts


def inside_share(cum: int, overall: int, share: Decimal) -> bool:
    """``cum / overall <= share`` without dividing."""
    num, den = share.as_integer_ratio()
    return cum * den <= overall * num if overall > 0 else cum * den >= overall * num


def share_cuts(values: DataFrame, value: str, shares: Sequence[str], scale: int = 2,
               bins: int = BINS) -> tuple[list[Decimal | None], Decimal | None]:
    """For each share s (0 < s < 1) the smallest ``value`` v such that the
    sum of all values >= v is within s of the grand total; ``None`` if not
    even the largest is.  Also the grand total (``None`` without values).

    Values (NULLs aside) have at most ``scale`` decimal places.  Largest
    first, the cumulative sum first rises and then, over negative values,
    falls to the total; so the values within the share are those down to one
    cut, for a negative total too (there the comparison turns round).
    A total of 0 has no cuts (all ``None``).
    """
    wanted = [Decimal(s) for s in shares]
    if any(not 0 < s < 1 for s in wanted):
        raise ValueError("a share lies between 0 and 1")
    return _remembered(values, ("cuts", value, *wanted, scale), lambda: _share_cuts(values, value, wanted, scale, bins))


def _share_cuts(values: DataFrame, value: str, wanted: list[Decimal], scale: int, bins: int):
    unit = (F.col(value) * F.lit(10**scale)).cast("decimal(38,0)").cast("long").alias("v")
    units = values.where(F.col(value).isNotNull()).select(unit)
    lo, hi, total = units.agg(F.min("v"), F.max("v"), F.sum(F.col("v").cast("decimal(38,0)"))).first()
    if lo is None:
        return [None] * len(wanted), None
    overall = int(total)
    grand = Decimal(overall).scaleb(-scale)
    if overall == 0:
        return [None] * len(wanted), grand
    # Per share: the interval that holds the cut, and the sum above it.
    open_, cuts = {k: (lo, hi, 0) for k in range(len(wanted))}, [None] * len(wanted)
    while open_:
        searches = sorted(set(open_.values()))
        found = _sums(units, [(a, b) for a, b, _ in searches], bins)
        for k, (a, b, above) in list(open_.items()):
            cum = above
            for least, greatest, in_bin in sorted(found[searches.index((a, b, above))], reverse=True):
                if not inside_share(cum + in_bin, overall, wanted[k]):
                    break
                cum += in_bin
                cuts[k] = Decimal(least).scaleb(-scale)
            # The values of this bin are the first that leave the share.
            if least == greatest:
                del open_[k]
            else:
                open_[k] = (least, greatest, cum)
    return cuts, grand


def _width(lo: int, hi: int, bins: int) -> int:
    return (hi - lo) // bins + 1


def _sums(units: DataFrame, intervals: list[tuple[int, int]], bins: int) -> list[list[tuple[int, int, int]]]:
    """Per interval ``(least value, greatest value, sum)`` of its non-empty
    bins, one pass for all."""
    tried = [
        F.when(F.col("v").between(lo, hi), F.struct(
            F.lit(i).alias("i"), F.lit(lo).cast("long").alias("from"), F.lit(_width(lo, hi, bins)).cast("long").alias("w")))
        for i, (lo, hi) in enumerate(intervals)]
    rows = (
        units.select("v", F.explode(F.array_compact(F.array(*tried))).alias("at")).select("v", "at.*")
        .groupBy("i", F.expr("(v - `from`) DIV w").alias("bin"))
        .agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect())
    out: list[list] = [[] for _ in intervals]
    for r in rows:
        out[r["i"]].append((r["lo"], r["hi"], int(r["s"])))
    return out


# ------------------------------------------------------------ rank limits


@dataclass(frozen=True)
class Digit:
    """One ``long`` of an order: its expression and its range."""

    expr: Column
    lo: int
    hi: int


def _unit(name: str, kind: T.DataType) -> Column:
    """The column as an order-preserving long."""
    if isinstance(kind, T.DecimalType):
        return (F.col(name) * F.lit(Decimal(10) ** kind.scale)).cast("decimal(38,0)").cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("long")
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("long")
    raise TypeError(f"{name}: no selection over {kind.simpleString()}")


def _string_digits(name: str, bytes_: int) -> list[Digit]:
    """Numbers whose order is the byte order of a string of at most
    ``bytes_`` bytes; NULL comes last."""
    raw, top = F.col(name).cast("binary"), 1 << 8 * CHARS
    out = []
    for at in range(0, max(bytes_, 1), CHARS):
        part = F.rpad(F.hex(F.substring(raw, at + 1, CHARS)), 2 * CHARS, "0")
        out.append(Digit(F.coalesce(F.conv(part, 16, 10).cast("long"), F.lit(top)), 0, top))
    return out + [Digit(F.coalesce(F.octet_length(name).cast("long"), F.lit(0)), 0, max(bytes_, 1))]


def _orders(df: DataFrame, sorts: Sequence, key: Sequence[str]) -> tuple[int, list[list[Digit]]]:
    """The row count, and per sort key its digits: the value, then the key
    columns ascending, NULLs last."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = dict.fromkeys([s.col for s in sorts] + list(key))
    for s in sorts:
        _unit(s.col, kinds[s.col])
    facts = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        if isinstance(kinds[c], T.StringType):
            facts.append(F.max(F.octet_length(c)).alias(f"b{i}"))
        else:
            unit = _unit(c, kinds[c])
            facts += [F.min(unit).alias(f"lo{i}"), F.max(unit).alias(f"hi{i}")]
    row = df.agg(*facts).first()
    place = {c: i for i, c in enumerate(columns)}

    def number(c: str, descending: bool, nulls_first: bool) -> Digit:
        lo, hi = row[f"lo{place[c]}"] or 0, row[f"hi{place[c]}"] or 0
        unit = _unit(c, kinds[c])
        lo, hi, unit = (-hi, -lo, -unit) if descending else (lo, hi, unit)
        return Digit(F.coalesce(unit, F.lit(lo - 1 if nulls_first else hi + 1).cast("long")), lo - 1, hi + 1)

    last = []
    for c in key:
        last += _string_digits(c, row[f"b{place[c]}"] or 0) if isinstance(kinds[c], T.StringType) else [number(c, False, False)]
    return row["n"], [[number(s.col, s.descending, s.nf), *last] for s in sorts]


@dataclass
class _Search:
    """Where one position is sought: rows whose first digits are ``fixed``
    and whose next one lies in ``lo .. hi``; ``rank`` counts among them."""

    order: int
    rank: int
    lo: int
    hi: int
    fixed: tuple[int, ...] = ()
    found: bool = False

    def place(self) -> tuple:
        return self.order, self.fixed, self.lo, self.hi


def _matches(digits: list[Digit], fixed: tuple[int, ...]) -> Column:
    cond = F.lit(True)
    for d, value in zip(digits, fixed):
        cond = cond & (d.expr == F.lit(value))
    return cond


def rank_limits(df: DataFrame, sorts: Sequence, key: Sequence[str], positions: Callable[[int], Sequence[Sequence[int]]],
                bins: int = BINS) -> list[list]:
    """Per sort key the rows (value and key columns) at the 1-based
    ``positions(row count)[sort]`` of the order (sort key, ``key``
    ascending); ``key`` is unique.  ``df`` is a written table; each pass
    reads it once for all searches."""
    n, orders = _orders(df, sorts, key)
    searches = [
        _Search(i, p, orders[i][0].lo, orders[i][0].hi) for i, wanted in enumerate(positions(n)) for p in wanted]
    while any(not s.found for s in searches):
        places = sorted({s.place() for s in searches if not s.found})
        tried = []
        for k, (i, fixed, lo, hi) in enumerate(places):
            d = orders[i][len(fixed)].expr
            tried.append(F.when(
                _matches(orders[i], fixed) & d.between(lo, hi),
                F.struct(F.lit(k).alias("k"), F.lit(lo).cast("long").alias("lo"), F.lit(_width(lo, hi, bins)).cast("long").alias("w"),
                         d.alias("d"))))
        rows = (
            df.select(F.explode(F.array_compact(F.array(*tried))).alias("at")).select("at.*")
            .groupBy("k", F.expr("(d - lo) DIV w").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect())
        counted: dict[tuple, list] = {p: [] for p in places}
        for r in rows:
            counted[places[r["k"]]].append((r["lo"], r["hi"], r["n"]))
        for s in searches:
            if s.found:
                continue
            for lo, hi, count in sorted(counted[s.place()]):
                if s.rank <= count:
                    break
                s.rank -= count
            s.lo, s.hi = lo, hi
            if lo == hi:
                s.fixed += (lo,)
                digits = orders[s.order]
                s.found = count == 1 or len(s.fixed) == len(digits)
                if not s.found:
                    s.lo, s.hi = digits[len(s.fixed)].lo, digits[len(s.fixed)].hi
    return _fetched(df, sorts, key, orders, searches)


def _fetched(df: DataFrame, sorts: Sequence, key: Sequence[str], orders: list[list[Digit]], searches: list[_Search]) -> list[list]:
    if not searches:
        return [[] for _ in sorts]
    hit = [F.when(_matches(orders[s.order], s.fixed), F.lit(k)) for k, s in enumerate(searches)]
    columns = list(dict.fromkeys([s.col for s in sorts] + list(key)))
    rows = df.select(*columns, F.explode(F.array_compact(F.array(*hit))).alias("__k")).dropDuplicates(["__k"]).collect()
    of = {r["__k"]: r for r in rows}
    out: list[list] = [[] for _ in sorts]
    for k, s in enumerate(searches):
        out[s.order].append(of[k])
    return out


def _after(row_value, limit, descending: bool, nulls_first: bool) -> tuple[Column, Column]:
    """(strictly after, equal) of a column against a value."""
    if limit is None:
        return (row_value.isNotNull() if nulls_first else F.lit(False)), row_value.isNull()
    later = row_value < F.lit(limit) if descending else row_value > F.lit(limit)
    later = F.coalesce(later, F.lit(not nulls_first))
    return later, row_value.eqNullSafe(F.lit(limit))


def after_limit(limit, sort, key: Sequence[str]) -> Column:
    """Whether a row comes after the row ``limit`` in the order."""
    later, equal = _after(F.col(sort.col), limit[sort.col], sort.descending, sort.nf)
    for c in key:
        more, same = _after(F.col(c), limit[c], False, False)
        later, equal = later | (equal & more), equal & same
    return later


def ntiles(df: DataFrame, specs: Sequence[tuple], key: Sequence[str], bins: int = BINS) -> DataFrame:
    """``df`` with several NTILEs over numeric or date columns: ``specs`` is
    a list of ``(out, k, sort key)``, ``key`` the unique key and tie-break.

    The last row of every tile but the last one is found by counting
    (``rank_limits``); a row's tile is one more than the limits before it,
    one projection without a sort, a shuffle or a join.  ``df`` is a written
    table.
    """
    key = list(key)

    def ends(n: int) -> list[list[int]]:
        out = []
        for _, k, _ in specs:
            small, more = divmod(n, k)
            last = [j * small + min(j, more) for j in range(1, k)]
            out.append(sorted({e for e in last if 0 < e < n}))
        return out

    question = ("ntiles", *((k, s) for _, k, s in specs), *key)
    limits = _remembered(df, question, lambda: rank_limits(df, [s for _, _, s in specs], key, ends, bins))
    tiles = []
    for (name, _, sort), own in zip(specs, limits):
        tile = F.lit(1)
        for limit in own:
            tile = tile + after_limit(limit, sort, key).cast("int")
        tiles.append(tile.cast("bigint").alias(name))
    return df.select(*df.columns, *tiles)
