"""Token-id files: frequency-ranked ids in byte-aligned variable-length
coding with separate control bytes.

1. Texts are encoded once; the ids (two bytes each for vocabularies up to
   65,536) are written as a Parquet table.
2. Ids are counted per task and summed (one row per id that occurs: bounded
   by the vocabulary); the commonest id gets rank 0, so it takes one byte.
3. The documents are range-partitioned by id; each task codes the ranks of
   its range (``varbytes``) and writes them as one file of blocks; the table of committed files is the index.  The dictionary
   (rank -> id) lies beside them as a Parquet table.
4. Reading takes one file per task, a block at a time, and decodes whole
   blocks by table lookup.

File: blocks of ``HEAD`` (magic, documents, bytes of control, of data),
then int64 document ids, a byte per document (1: it has an id), int64
counts, the control bytes and the data bytes.

Defined results
---------------
* null and empty texts hold the end id alone.
* rows without an id come after all others (id null on reading back).
* repeated rows are written as often as they occur, next to each other.
* an empty table gives no file and an empty result; other columns are
  ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import varbytes
from .blobs import new_file, open_read, open_write
from .common import drop_tables, empty_if_null, new_folder, write_table
from .subwords import encoder

HEAD = "<4sIQQ"
MAGIC = b"VBT1"
BLOCK_BYTES = 1 << 22  # of ids in a block, about


@dataclass(frozen=True)
class TokenFiles:
    """``files``: path, part, n_docs, n_tokens of each file, in order;
    ``dictionary``: rank, id, n (occurrences)."""

    files: DataFrame
    dictionary: DataFrame


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (little-endian bytes, two or four per id)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), empty_if_null(F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            ids = [a.tobytes() + end for a in enc.arrays(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids binary")


def _flat(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column in a row, and the count per entry."""
    sizes = np.array([len(x.as_buffer()) for x in column], np.int64) if len(column) else np.empty(0, np.int64)
    joined = b"".join(x.as_buffer() for x in column)
    return np.frombuffer(joined, dtype), sizes // dtype.itemsize


def _slices(b: pa.RecordBatch, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``most`` bytes of ids."""
    sizes = np.cumsum([len(x.as_buffer()) for x in b.column("ids")])
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most)))
        yield b.slice(lo, hi - lo)
        lo = hi


def write_token_files(tokens: DataFrame, dtype: str = "<u2") -> TokenFiles:
    """Files of a written ``doc_id, ids`` table, in ascending id order."""
    spark = tokens.sparkSession
    width = np.dtype(dtype)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for whole in batches:
            for b in _slices(whole):
                seen = np.bincount(_flat(b.column("ids"), width)[0], minlength=len(total))
                seen[: len(total)] += total
                total = seen
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    summed = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    order = sorted((-r["n"], r["id"]) for r in summed)
    id_of_rank = np.array([i for _, i in order], np.uint32)
    rank_of_id = np.zeros(int(id_of_rank.max()) + 1 if len(order) else 1, np.uint32)
    rank_of_id[id_of_rank] = np.arange(len(order), dtype=np.uint32)
    dictionary = write_table(
        spark.createDataFrame(
            [(r, i, -n) for r, (n, i) in enumerate(order)], "rank long, id long, n long").coalesce(1), "token-dictionary")

    folder = new_folder(spark, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, sink, part, n_docs, n_tokens = None, None, None, 0, 0
        for whole in batches:
            for b in _slices(whole):
                if sink is None:
                    path, part = new_file(folder, ".vbt"), b.column("part")[0].as_py()
                    sink = open_write(path)
                ids, counts = _flat(b.column("ids"), width)
                control, data = varbytes.encode(rank_of_id[ids], counts)
                doc_id = b.column("doc_id")
                sink.write(struct.pack(HEAD, MAGIC, b.num_rows, len(control), len(data)))
                sink.write(doc_id.fill_null(0).to_numpy().astype("<i8").tobytes())
                sink.write(doc_id.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
                sink.write(counts.astype("<i8").tobytes())
                sink.write(control.tobytes())
                sink.write(data.tobytes())
                n_docs, n_tokens = n_docs + b.num_rows, n_tokens + len(ids)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([part], pa.int32()), pa.array([n_docs]), pa.array([n_tokens])],
                ["path", "part", "n_docs", "n_tokens"])

    # Rows that share an id, or have none, are spread by their ids' hash.
    order = [F.col("doc_id").asc_nulls_last(), F.col("spread")]
    files = (
        tokens.withColumn("spread", F.xxhash64("ids")).repartitionByRange(*order).sortWithinPartitions(*order, "ids")
        .drop("spread").withColumn("part", F.spark_partition_id())
        .mapInArrow(write, "path string, part int, n_docs long, n_tokens long")
    )
    return TokenFiles(write_table(files, "token-index"), dictionary)


def read_token_files(spark: SparkSession, stored: TokenFiles, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and with ``with_ids`` the
    ``ids`` (array<int>), decoded from the files, one file per task."""
    index = sorted((r["part"], r["path"], r["n_tokens"]) for r in stored.files.collect())
    id_of_rank = np.array(
        [r["id"] for r in sorted(stored.dictionary.select("rank", "id").collect(), key=lambda r: r["rank"])], np.uint32)
    starts, total = [], 0
    for _, path, n in index:
        starts.append((path, total))
        total += n
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                with open_read(path) as f:
                    size = f.size()
                    while f.tell() < size:
                        magic, n, n_control, n_data = struct.unpack(HEAD, f.read(struct.calcsize(HEAD)))
                        if magic != MAGIC:
                            raise ValueError(f"not a token file: {path}")
                        ids = np.frombuffer(f.read(8 * n), "<i8")
                        known = np.frombuffer(f.read(n), np.uint8).astype(bool)
                        counts = np.frombuffer(f.read(8 * n), "<i8")
                        control = np.frombuffer(f.read(n_control), np.uint8)
                        data = np.frombuffer(f.read(n_data), np.uint8)
                        codes = id_of_rank[varbytes.decode(control, data, counts)].astype("<u4")
                        ends = np.cumsum(counts)
                        first = ends - counts
                        raw = memoryview(codes).cast("B")
                        crc = [zlib.crc32(raw[4 * lo:4 * hi]) for lo, hi in zip(first.tolist(), ends.tolist())]
                        cols = [pa.array(ids, mask=~known), pa.array(start + first), pa.array(counts),
                                pa.array(crc, pa.int64())]
                        if with_ids:
                            cols.append(pa.array(
                                [codes[lo:hi].astype("<i4") for lo, hi in zip(first.tolist(), ends.tolist())],
                                pa.list_(pa.int32())))
                        yield pa.RecordBatch.from_arrays(cols, names)
                        start += int(counts.sum())

    paths = spark.createDataFrame(starts, "path string, start long").repartition(max(1, len(starts)))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return paths.mapInArrow(read, schema)


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int,
                     id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Tokenise ``docs`` and write them as token files."""
    tokens = write_table(token_table(docs, tokenizer_path, end_id, id_col, text_col), "token-ids")
    stored = write_token_files(tokens, encoder(tokenizer_path).dtype.str)
    drop_tables(tokens)
    return stored
