"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bulk-synchronous best fit.  Pieces are range-sorted by length once and
numbered within their length; a superstep takes all pieces of one length
(longest first) and sweeps over the sorted gaps from their successor (the
smallest gap that holds the length) upwards: the piece of rank r takes the
r-th place, pieces that found none open new sequences, the gaps are
updated, and the next superstep begins.  Equal gaps are interchangeable, so
gaps are kept as runs ``(gap, first sequence, count)`` and a superstep's
matches as runs of ranks.  Their number depends on ``capacity`` (lengths
and gaps are at most that), not on the number of documents.  Per-length
counts reach the driver, and the sweeps run there (``best_fit_plan``), one
loop over at most ``capacity`` lengths: a superstep needs the gaps that the
one before left, and a Spark job for each would cost more than its few runs.
The plan goes to the tasks, where every piece finds its run by its rank, in
parallel.

Defined results
---------------
* null and empty texts are one piece that holds the end id alone.
* rows without an id are packed like others (id null); repeated rows are
  packed as often as they occur.
* an empty table gives an empty result; other columns are ignored.
* pieces of equal length are numbered by id, piece and place in the input.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_offsets, drop_tables, empty_if_null, with_position, write_table
from .subwords import encoder

CAPACITY = 2048


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Documents as ids (with ``end_id`` last), cut into pieces of at most
    ``capacity``: only longer documents are cut, the first piece takes what
    is left over.  ``doc_id, piece, start, length, ids_crc32`` and with
    ``with_ids`` the ``ids`` themselves."""
    rows = docs.select(F.col(id_col).alias("doc_id"), empty_if_null(F.col(text_col)).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, codes in enumerate(enc.arrays(b.column("text"))):
                codes = np.append(codes.astype("<u4"), np.array([end_id], "<u4"))
                first = len(codes) % capacity or capacity
                cuts = [0, *range(min(first, len(codes)), len(codes) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    at.append(i)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(codes[lo:hi].tobytes()))
                    if with_ids:
                        ids.append(codes[lo:hi].astype("<i4"))
            cols = [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(run, schema + ", ids array<int>" * with_ids)


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Matches of all supersteps for ``counts`` pieces of each length.

    Rows ``(length, first rank, pieces, first sequence, pieces per
    sequence, offset)``: the j-th piece of a row goes to sequence ``first +
    j // per`` at ``offset + (j % per) * length``.  Also the number of
    sequences.
    """
    gaps: list[int] = []  # sorted sizes of the open gaps
    runs: dict[int, list[tuple[int, int]]] = {}  # size -> (first sequence, count)
    plan, opened = [], 0

    def update(gap: int, first: int, count: int) -> None:
        if gap > 0:
            if gap not in runs:
                insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, count))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} outside 1..{capacity}")
        rank, left = 0, counts[length]
        changed = []  # gaps after this superstep, visible in the next
        while left:
            k = bisect_left(gaps, length)
            if k < len(gaps):
                gap = gaps[k]
                first, count = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap]
                    gaps.pop(k)
            else:
                gap, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            per = gap // length
            full = min(count, left // per)
            if full:
                plan.append((length, rank, full * per, first, per, capacity - gap))
                changed.append((gap - per * length, first, full))
                rank, left = rank + full * per, left - full * per
                first, count = first + full, count - full
            if count and left < per:
                if left:  # the last pieces of this length share one sequence
                    plan.append((length, rank, left, first, per, capacity - gap))
                    changed.append((gap - left * length, first, 1))
                    first, count, left = first + 1, count - 1, 0
                if count:
                    changed.append((gap, first, count))
        for c in changed:
            update(*c)
    return np.array(plan, np.int64).reshape(-1, 6), opened


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table with ``doc_id, piece, length`` and more)
    with ``sequence_id`` and ``offset``."""
    keep = pieces.columns
    ranked = with_position(pieces.withColumn("_row", F.monotonically_increasing_id()),
                           ["length", "doc_id", "piece", "_row"], "pack-ranked")
    base, seen = {}, {}
    for length, part, first, n in class_offsets(ranked, "length"):
        base[length, part] = seen.get(length, 0) - first
        seen[length] = seen.get(length, 0) + n
    plan, _ = best_fit_plan(seen, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    keys = plan[:, 0] << 44 | plan[:, 1]
    base_keys = np.array([k << 32 | p for k, p in sorted(base)], np.int64)
    base_values = np.array([base[k] for k in sorted(base)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, part, idx = (b.column(c).to_numpy().astype(np.int64) for c in ("length", "_part", "_idx"))
            rank = idx + base_values[np.searchsorted(base_keys, length << 32 | part)]
            m = plan[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            j = rank - m[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(m[:, 3] + j // m[:, 4]),
                 pa.array(m[:, 5] + j % m[:, 4] * length)], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: one row per piece."""
    pieces = write_table(token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col, with_ids), "pack-pieces")
    packed = best_fit_pack(pieces, capacity)
    drop_tables(pieces)
    return packed
