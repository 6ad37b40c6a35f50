"""MinHash near-dedup by a multi-index Hamming join.

A document's signature holds, for each of ``positions`` hash functions,
``bits`` bits of the least hash over its word-shingle set.  Signatures of
sets with Jaccard similarity J differ in about (1 - J) of the positions, so
the ``distance`` that a linked pair exceeds with probability ``miss`` at
most follows from the threshold.  Found are *all* pairs of signatures
within that distance: of m = distance // (errors + 1) + 1 chunks of
positions at least one has ``errors`` or fewer differences, and every choice
of ``errors`` positions of a chunk is left out in turn (it stands for all
values they can take); what is left of the chunk is the key that two
documents must share.

1. *Signatures* of whole texts, one pass.  Documents with equal sets are one
   vertex.
2. *Star rounds.*  First every vertex is tried against the most central
   member (the one that shares most with others) of the key that they meet
   under most often; then, in ``ROUNDS`` rounds, every vertex outside a
   key's largest component against the closest few of random members of
   that component.  Pairs beyond the distance go; the others are confirmed
   on full sets.  Confirmed links give components, so a group of copies is
   never expanded into pairs.
3. *The rest.*  Pairs of different components that share a key.  Keys of
   few members (``SMALL_KEY``) give pairs, held to the distance by a sketch
   of two bits per position while they are formed, then confirmed as above.
   Larger keys are not expanded: their members meet in blocks of a bounded
   number, and components that close sketches (the test of the small keys)
   connect there form a cluster; its members outside its largest component
   meet all of it in blocks of a bounded number of shingles, whose full sets
   are compared inside the task, so only links leave it.

Full sets are made again from the texts that a Bloom filter over the wanted
ids lets through; whole texts are never shuffled.  Sets hold 64-bit hashes
of shingles: two unlike shingles count as one with probability 2^-64 a
pair, so ``n_shingles`` and the confirmation are exact up to that.

Defined results
---------------
* null text and text without words: no shingles, linked with nothing, kept.
* texts of any length are taken whole; fewer than ``k`` words are one
  shingle.
* rows without an id link like others; a component's id is its smallest
  known id (null if it has none), and a row without an id is kept only in
  such a component.
* repeated rows and equal texts are in one component; rows that share the
  component's id are all kept; an empty table gives an empty result; other
  columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import parallelism, small_batches
from .bloom import bloom_filter, may_hold
from .common import drop_tables, empty_if_null, write_table
from .components import components
from .shingles import Shingler, set_key

# Odd multipliers of the hash functions.
ODD_A, ODD_B = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
SEED = 20_231
ROUNDS = 1
CLOSEST = 4
SMALL_KEY = 32
BLOCK_MEMBERS = 4096
BLOCK_TOKENS = 400_000


def least_distance(positions: int, percent: int, miss: float) -> int:
    """The smallest distance that a pair at the threshold exceeds with
    probability ``miss`` at most (binomial tail)."""
    p = 1 - percent / 100
    tail, d = 1.0, 0
    while d < positions:
        tail -= math.comb(positions, d) * p ** d * (1 - p) ** (positions - d)
        if tail <= miss:
            return d
        d += 1
    return positions


class Signer:
    def __init__(self, positions: int, bits: int):
        rng = np.random.default_rng(SEED)
        self.add = rng.integers(1, 1 << 63, positions, dtype=np.uint64)
        self.low = np.uint64((1 << bits) - 1)

    def sign(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of ``uint16`` per set (zeros for an empty one)."""
        out = np.zeros((len(sets), len(self.add)), np.uint16)
        full = [i for i, s in enumerate(sets) if len(s)]
        if full:
            tokens = np.concatenate([sets[i] for i in full])
            starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
            for j, add in enumerate(self.add):
                h = (tokens ^ add) * np.uint64(ODD_A)
                h ^= h >> np.uint64(32)
                h *= np.uint64(ODD_B)
                least = np.minimum.reduceat(h, starts)
                out[full, j] = ((least ^ (least >> np.uint64(29))) & self.low).astype(np.uint16)
        return out


def signature_table(docs: DataFrame, k: int, positions: int, bits: int) -> DataFrame:
    """Per row ``doc_id, h`` (hash of the id), ``n, s`` (name of the set)
    and ``sig``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(k), Signer(positions, bits)
        for b in batches:
            n, s, sig, group, size = [], [], [], [], 0

            def flush():
                sig.extend(r.tobytes() for r in signer.sign(group))
                group.clear()

            for tokens in shingler.sets(b.column("text")):
                n.append(len(tokens))
                s.append(set_key(tokens))
                group.append(tokens)
                size += len(tokens)
                if size > 50_000:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h"), pa.array(n, pa.int64()), pa.array(s, pa.binary()),
                 pa.array(sig, pa.binary())], ["doc_id", "h", "n", "s", "sig"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_type}, h long, n long, s binary, sig binary")


def chunk_choices(positions: int, distance: int, errors: int) -> list[tuple[int, ...]]:
    """The positions that make a key: every chunk without every choice of
    ``errors`` of its positions.  Two signatures within ``distance`` agree on
    all positions of at least one choice."""
    chunks = np.array_split(np.arange(positions), min(positions, distance // (errors + 1) + 1))
    return [tuple(int(p) for p in c if p not in out)
            for c in chunks for out in combinations(c, min(errors, len(c) - 1))]


def _matrix(column: pa.Array, positions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, positions)


def _keys(sig: np.ndarray, choices: list[tuple[int, ...]]) -> np.ndarray:
    """The keys (int64) of the rows of ``sig`` (uint64), those of a row
    together."""
    keys = np.empty((len(sig), len(choices)), np.uint64)
    for c, chosen in enumerate(choices):
        h = np.full(len(sig), (c + 1) * ODD_A & (1 << 64) - 1, np.uint64)
        for p in chosen:
            h = (h ^ sig[:, p]) * np.uint64(ODD_B)
            h ^= h >> np.uint64(31)
        keys[:, c] = h
    return keys.ravel().view(np.int64)


def key_sizes(signatures: DataFrame, positions: int, choices: list[tuple[int, ...]]) -> DataFrame:
    """``key, size``: the vertices of each key.  Most keys are of one vertex,
    so a partial sum per task would hold nearly all of its keys and save
    nothing: counted are the repeats within a batch, and the rest after the
    exchange."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, n = np.unique(_keys(_matrix(b.column("sig"), positions).astype(np.uint64), choices), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

    counted = signatures.select("sig").mapInArrow(run, "key long, n long")
    return counted.repartition("key").groupBy("key").agg(F.sum("n").alias("size"))


def key_table(signatures: DataFrame, positions: int, choices: list[tuple[int, ...]],
              only: np.ndarray | None = None) -> DataFrame:
    """``key, row, n, s0, s1``: every key of every vertex (those that the
    Bloom filter ``only`` may hold) with its sketch, the two lowest bits of
    the first 64 positions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                sig = _matrix(part.column("sig"), positions).astype(np.uint64)
                keys = _keys(sig, choices)
                sketch = []
                for bit in (0, 1):
                    lowest = np.zeros((len(sig), 64), np.uint8)
                    lowest[:, :positions] = (sig[:, :64] >> np.uint64(bit)) & np.uint64(1)
                    sketch.append(np.packbits(lowest, axis=1, bitorder="little").view(np.int64).ravel())
                at = np.flatnonzero(may_hold(only, keys)) if only is not None else np.arange(len(keys))
                of = at // len(choices)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at]), *(
                        pa.array(x[of]) for x in (part.column("row").to_numpy(), part.column("n").to_numpy(), *sketch))],
                    ["key", "row", "n", "s0", "s1"])

    return signatures.select("row", "n", "sig").mapInArrow(run, "key long, row long, n long, s0 long, s1 long")


def _sizes_fit(x: Column, y: Column, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _sketches_fit(x: str, y: str, distance: int) -> Column:
    differ = [F.col(f"{x}s{i}").bitwiseXOR(F.col(f"{y}s{i}")) for i in (0, 1)]
    return F.bit_count(differ[0].bitwiseOR(differ[1])) <= distance


def _star_pairs(tried: DataFrame, percent: int, distance: int, closest: int) -> DataFrame:
    """Each vertex with the ``closest`` pivots (``a``), those that it meets
    under most keys."""
    tried = tried.where(
        (F.col("row") != F.col("a.row")) & _sizes_fit(F.col("n"), F.col("a.n"), percent) & _sketches_fit("", "a.", distance))
    met = tried.groupBy("row", F.col("a.row").alias("pivot")).agg(F.count(F.lit(1)).alias("m"))
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("m"), "pivot"))
    return met.withColumn("place", place).where(F.col("place") <= closest).select(
        F.least("row", "pivot").alias("x"), F.greatest("row", "pivot").alias("y")).distinct()


def _within(pairs: DataFrame, signatures: DataFrame, positions: int, distance: int) -> DataFrame:
    """The ``x, y`` whose signatures differ in ``distance`` positions at
    most."""
    sig = signatures.select("row", "sig")
    joined = (
        pairs.join(sig.withColumnsRenamed({"row": "x", "sig": "sx"}), "x")
        .join(sig.withColumnsRenamed({"row": "y", "sig": "sy"}), "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            differ = (_matrix(b.column("sx"), positions) != _matrix(b.column("sy"), positions)).sum(axis=1)
            keep = pa.array(differ <= distance)
            yield pa.RecordBatch.from_arrays([b.column("x").filter(keep), b.column("y").filter(keep)], ["x", "y"])

    return joined.select("x", "y", "sx", "sy").mapInArrow(run, "x long, y long")


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``row, toks`` of the ``wanted`` vertices (``row, s, rep_h``)."""
    bits = bloom_filter(wanted, F.col("rep_h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for b in batches:
            texts = b.column("text").filter(pa.array(may_hold(bits, b.column("h").to_numpy())))
            sets = list(shingler.sets(texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())],
                ["s", "toks"])

    found = docs.select("h", "text").mapInArrow(run, "s binary, toks binary").where(F.length("toks") > 0)
    return found.join(wanted.select("row", "s"), "s").dropDuplicates(["row"]).select("row", "toks")


def _confirmed(pairs: DataFrame, docs: DataFrame, vertices: DataFrame, k: int, percent: int) -> DataFrame:
    """The ``x, y`` of the written ``pairs`` whose full sets reach the
    threshold, written."""
    rows = pairs.select(F.col("x").alias("row")).unionByName(pairs.select(F.col("y").alias("row"))).distinct()
    wanted = write_table(vertices.join(rows, "row").select("row", "s", "rep_h"), "near-wanted")
    full = write_table(_full_sets(docs, wanted, k), "near-full")
    joined = (
        pairs.join(full.withColumnsRenamed({"row": "x", "toks": "tx"}), "x")
        .join(full.withColumnsRenamed({"row": "y", "toks": "ty"}), "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for tx, ty in zip(b.column("tx"), b.column("ty")):
                x, y = np.frombuffer(tx.as_buffer(), np.uint64), np.frombuffer(ty.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("x").filter(mask), b.column("y").filter(mask)], ["x", "y"])

    links = write_table(joined.select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long"), "near-links")
    drop_tables(wanted, full, pairs)
    return links


def _cross_pairs(shared: DataFrame, clusters: DataFrame, percent: int, distance: int) -> DataFrame:
    """Pairs of different components and clusters under a small key: those
    outside the key's largest component (``odd``) against all, by size
    class."""
    width = max(math.log(100 / percent), 1e-6) * (1 + 1e-9)
    size = F.floor(F.log("n") / width)
    fields = ("row", "n", "s0", "s1", "comp", "cluster")
    small = shared.where(F.col("size") <= SMALL_KEY).join(clusters, "row", "left")
    x = small.where("odd").select(
        "key", F.explode(F.array(size - 1, size, size + 1)).alias("class"), F.struct(*fields).alias("x"))
    y = small.select("key", size.alias("class"), F.struct(*fields, "odd").alias("y"))
    apart = F.coalesce(F.col("x.cluster") != F.col("y.cluster"), F.lit(True))
    met = x.join(y, ["key", "class"]).where(
        (F.col("x.comp") != F.col("y.comp")) & apart & (~F.col("y.odd") | (F.col("x.row") < F.col("y.row")))
        & _sizes_fit(F.col("x.n"), F.col("y.n"), percent) & _sketches_fit("x.", "y.", distance))
    return met.select(
        F.least("x.row", "y.row").alias("x"), F.greatest("x.row", "y.row").alias("y")).distinct()


def _own(n: str) -> Column:
    return F.pmod(F.xxhash64("row"), F.col(n)).cast("int")


def _each(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _tasks(spark: SparkSession) -> int:
    """For what is small in bytes and long in work: more tasks than the bytes
    ask for."""
    return max(4 * parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))


def _clusters(shared: DataFrame, percent: int, distance: int) -> DataFrame:
    """``row, cluster``: the members of large keys by components that such
    keys bring together with close sketches, and all that are connected so.
    Within a key those outside its largest component (dealt over the blocks
    bx) meet all (dealt over the blocks by)."""
    def blocks(members: str) -> Column:
        return F.ceil(F.col(members) / F.lit(BLOCK_MEMBERS)).cast("int")

    fields = ("row", "n", "s0", "s1", "comp")
    hot = shared.where(F.col("size") > SMALL_KEY).select(
        "key", *fields, "odd", blocks("others").alias("nx"), blocks("size").alias("ny"))
    x = hot.where("odd").select("key", _own("nx").alias("bx"), _each("ny").alias("by"), F.lit(True).alias("is_x"), *fields)
    y = hot.select("key", _each("nx").alias("bx"), _own("ny").alias("by"), F.lit(False).alias("is_x"), *fields)
    group = ["key", "bx", "by"]
    met = x.unionByName(y).repartition(_tasks(shared.sparkSession), *group)
    close = met.groupBy(*group).applyInArrow(lambda t: close_in_block(t, percent, distance), "x long, y long")
    clusters = components(close.distinct()).withColumnsRenamed({"row": "comp", "label": "cluster"})
    return hot.select("row", "comp").distinct().join(clusters, "comp").select("row", "cluster")


def close_in_block(block: pa.Table, percent: int, distance: int) -> pa.Table:
    """Links between components that connect what the close pairs of the
    block connect, one at most for each: an ``is_x`` and another vertex of
    another component, sizes and sketches fitting, are a close pair."""
    comps, at = np.unique(block.column("comp").to_numpy(), return_inverse=True)
    n = block.column("n").to_numpy()
    sketch = [block.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1")]
    is_x = np.array(block.column("is_x").to_pylist(), bool)
    xs, ys = np.flatnonzero(is_x), np.flatnonzero(~is_x)
    up = np.arange(len(comps))  # the first component of one's part, as far as known
    for lo in range(0, len(xs), 64):
        i = xs[lo:lo + 64, None]
        differ = np.bitwise_count((sketch[0][i] ^ sketch[0][ys]) | (sketch[1][i] ^ sketch[1][ys]))
        fit = 100 * np.minimum(n[i], n[ys]) >= percent * np.maximum(n[i], n[ys])
        p, q = np.nonzero((differ <= distance) & fit & (at[i] != at[ys]))
        p, q = at[i[p, 0]], at[ys[q]]
        while len(p):
            p, q = up[p], up[q]
            apart = p != q
            p, q = p[apart], q[apart]
            np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
            while (up != up[up]).any():
                up = up[up]
    out = up != np.arange(len(comps))
    return pa.table({"x": comps[out], "y": comps[up[out]]})


def _blocks(shared: DataFrame, clusters: DataFrame) -> DataFrame:
    """``cluster, bx, by, is_x, row, comp``: which blocks a cluster's members
    meet in.  Members outside its largest component are dealt over the
    blocks bx, all members over the blocks by; each bx meets each by."""
    members = shared.where(F.col("size") > SMALL_KEY).select("row", "n", "comp").distinct().join(clusters, "row")
    sizes = members.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t"))
    facts = sizes.groupBy("cluster").agg(
        F.max(F.struct("m", "comp", "t")).alias("main"), F.sum("t").alias("all"), F.count(F.lit(1)).alias("comps"))
    facts = facts.where("comps > 1").select(
        "cluster", F.col("main.comp").alias("main"),
        F.ceil((F.col("all") - F.col("main.t")) / F.lit(BLOCK_TOKENS)).cast("int").alias("nx"),
        F.ceil(F.col("all") / F.lit(BLOCK_TOKENS)).cast("int").alias("ny"))
    placed = members.join(facts, "cluster")
    x = placed.where("comp != main").select(
        "cluster", _own("nx").alias("bx"), _each("ny").alias("by"), F.lit(True).alias("is_x"), "row", "comp")
    y = placed.select("cluster", _each("nx").alias("bx"), _own("ny").alias("by"), F.lit(False).alias("is_x"), "row", "comp")
    return x.unionByName(y)


def _block_links(blocks: DataFrame, docs: DataFrame, vertices: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (``x, y``) between different components within the blocks,
    written."""
    wanted = write_table(vertices.join(blocks.select("row").distinct(), "row").select("row", "s", "rep_h"), "near-wanted")
    full = write_table(_full_sets(docs, wanted, k), "near-full")
    group = ["cluster", "bx", "by"]
    met = blocks.join(full, "row").repartition(_tasks(docs.sparkSession), *group)
    links = write_table(
        met.groupBy(*group).applyInArrow(lambda t: linked_in_block(t, percent), "x long, y long").distinct(), "near-links")
    drop_tables(wanted, full)
    return links


def linked_in_block(block: pa.Table, percent: int) -> pa.Table:
    """Every ``is_x`` set against all others of another component: overlaps
    are counted over the block's tokens, numbered once."""
    lists = [np.frombuffer(t.as_buffer(), np.uint64) for t in block.column("toks")]
    is_x = np.array(block.column("is_x").to_pylist(), bool)
    row, comp = block.column("row").to_numpy(), block.column("comp").to_numpy()
    sides = [np.flatnonzero(is_x), np.flatnonzero(~is_x)]
    out = [(np.empty(0, np.int64),) * 2]
    if len(sides[0]) and len(sides[1]):
        tokens, flat = np.unique(np.concatenate([lists[i] for i in sides[1]]), return_inverse=True)
        sizes = np.array([len(lists[i]) for i in sides[1]])
        starts = np.cumsum(sizes) - sizes
        mark = np.zeros(len(tokens), np.int32)
        row_y, comp_y = row[sides[1]], comp[sides[1]]
        for i in sides[0]:
            at = np.flatnonzero(np.isin(tokens, lists[i], assume_unique=True))
            mark[at] = 1
            both = np.add.reduceat(mark[flat], starts)
            mark[at] = 0
            hit = (comp_y != comp[i]) & (100 * both >= percent * (len(lists[i]) + sizes - both))
            other = row_y[hit]
            out.append((np.minimum(other, row[i]), np.maximum(other, row[i])))
    return pa.table({"x": np.concatenate([o[0] for o in out]), "y": np.concatenate([o[1] for o in out])})


def _central(shared: DataFrame) -> DataFrame:
    """``shared`` with its key's most central member as pivot ``a``."""
    common = shared.groupBy("row").agg(F.sum("size").alias("common"))
    ranked = shared.join(common, "row")
    pivot = ranked.groupBy("key").agg(F.max(F.struct("common", "row", "n", "s0", "s1")).alias("a"))
    return shared.join(pivot, "key")


def _divided(shared: DataFrame, labels: DataFrame, salt: int) -> DataFrame:
    """``shared`` keys that more than one component has, with ``comp``,
    ``odd`` (outside the key's largest component), ``others`` (how many of
    the key are odd) and ``a``, a random member of the largest."""
    comp = (
        shared.drop("a", "comp", "odd", "others").join(labels, "row", "left")
        .withColumn("comp", F.coalesce("label", "row")).drop("label"))
    sizes = comp.groupBy("key", "comp").agg(
        F.count(F.lit(1)).alias("m"),
        F.min(F.struct(F.xxhash64("row", "key", F.lit(salt)).alias("h"), "row", "n", "s0", "s1")).alias("a"))
    lists = sizes.groupBy("key").agg(
        F.count(F.lit(1)).alias("comps"), F.max(F.struct("m", "comp", "a")).alias("b"),
        F.sum("m").alias("all")).where("comps > 1")
    return comp.join(
        lists.select("key", F.col("b.a").alias("a"), F.col("b.comp").alias("main"), (F.col("all") - F.col("b.m")).alias("others")),
        "key").withColumn("odd", F.col("comp") != F.col("main")).drop("main")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, positions: int = 64, bits: int = 16,
                    errors: int = 1, miss: float = 1e-5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, k, percent, positions, bits, errors, miss, id_col, text_col)


def _near_duplicates(docs: DataFrame, k: int, percent: int, positions: int, bits: int, errors: int, miss: float,
                     id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{id_col}`")).alias("h"),
                       empty_if_null(F.col(f"`{text_col}`")).alias("text"))
    distance = least_distance(positions, percent, miss)
    choices = chunk_choices(positions, distance, errors)
    base = write_table(
        signature_table(docs, k, positions, bits).withColumn("row", F.monotonically_increasing_id()), "near-base")
    known = base.where("n > 0")
    vertices = write_table(
        known.groupBy("s").agg(
            F.count(F.lit(1)).alias("copies"), F.min("row").alias("row"), F.min("doc_id").alias("rep"))
        .withColumn("rep_h", F.xxhash64("rep")), "near-vertices")
    signatures = write_table(
        known.select("row", "n", "sig").join(vertices.select("row"), "row", "left_semi"), "near-signatures")

    lists = write_table(key_sizes(signatures, positions, choices).where("size > 1"), "near-lists")
    common = key_table(signatures, positions, choices, bloom_filter(lists, F.col("key")))
    shared = write_table(common.join(lists, "key"), "near-shared")
    drop_tables(lists)

    def confirmed(pairs: DataFrame) -> DataFrame:
        close = write_table(_within(pairs, signatures, positions, distance), "near-pairs")
        return _confirmed(close, docs, vertices, k, percent)

    links = confirmed(_star_pairs(_central(shared), percent, distance, 1))
    labels = components(links)
    for step in range(ROUNDS + 1):
        divided = write_table(_divided(shared, labels, step), "near-shared")
        drop_tables(shared)
        shared = divided
        if step < ROUNDS:
            more = confirmed(_star_pairs(shared.where("odd"), percent, distance, CLOSEST))
        else:
            clusters = _clusters(shared, percent, distance)
            blocks = write_table(_blocks(shared, clusters), "near-blocks")
            more = _block_links(blocks, docs, vertices, k, percent).unionByName(
                confirmed(_cross_pairs(shared, clusters, percent, distance)))
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
    drop_tables(shared, signatures)

    named = vertices.join(labels, "row", "left").withColumn("label", F.coalesce("label", "row"))
    smallest = named.groupBy("label").agg(
        F.min("rep").alias("component_id"), F.sum("copies").alias("size")).where("size > 1")
    of_set = write_table(named.join(smallest, "label").select("s", "component_id", F.lit(1).alias("in")), "near-named")
    component = F.when(F.col("in").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return base.select("doc_id", "n", "s").join(of_set, "s", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"))
