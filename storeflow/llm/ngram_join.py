"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their word-shingle sets
is at least ``percent``/100.  Documents with equal sets are one vertex.

Prefix filter.  All sets are sorted by one global order, rare tokens first.
If ``x`` and ``y`` link, their first ``n - ceil(t n) + l`` tokens share at
least ``l``.  A longer prefix (larger ``l``) costs more postings but fewer
candidates, so each document takes the ``l`` with the least estimated cost;
a pair is verified when it shares at least the smaller of its two ``l``
prefix tokens.

1. *Who may link at all.*  Only tokens whose hash falls into a fixed share
   of the hash space (``WATCH`` times the part of a set that a link may
   miss) are counted over all documents; the order is: counted tokens by
   frequency, then the others by hash (a short document that lacks counted
   ones brings the few others that its prefix needs).  Tokens seen once
   match nothing; a document whose prefix holds nothing else is done.
2. *Exact order.*  For the remaining documents all tokens are counted.  The
   tokens no other one of them has bound every overlap (``shared`` tokens
   at most), so pairs that cannot reach the threshold are never formed.
3. *Star rounds.*  In each posting list all documents are tried against a
   few pivots (the one with the fewest tokens of its own, and random ones);
   verified links give components.  Linear in the postings, so a group of
   copies is never expanded into pairs.
4. *The rest, exactly.*  Pairs from different components: documents outside
   a list's largest component against all of the list, at the tokens that
   stand in the prefixes that the two sizes ask for (shorter than those for
   unknown partners).

Verification is exact on the full sets.  Sets of step 2 on come from the
texts of the remaining documents only.

Defined results
---------------
* null text and text without words: no shingles, linked with nothing.
* rows without an id link like others; a component's id is its smallest
  known id (null if it has none).
* repeated rows and equal texts are in one component; an empty table gives
  an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, empty_if_null, release, write_table
from .components import components
from .shingles import Shingler, set_key

WATCH = 1.75
MAX_MATCHES = 4
VERIFY_COST = 4.0  # of a candidate, in postings
PIVOTS = 3


def _least_overlap(n, percent: int):
    """Shared tokens that a link of a set of ``n`` needs at least."""
    return -(-(percent * n) // 100)


def _watched(tokens: np.ndarray, percent: int) -> np.ndarray:
    share = min(1.0, WATCH * (100 - percent) / 100)
    return (tokens & np.uint64(0xFFFF)) < np.uint64(int(65536 * share))


def _may_link(nx: Column, cx: Column, ny: Column, cy: Column, percent: int) -> Column:
    """Whether an overlap of ``min(cx, cy)`` would reach the threshold."""
    most = F.least(cx, cy)
    return 100 * most >= percent * (nx + ny - most)


def set_table(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per row ``doc_id, n, s`` (name of the set), ``wc`` and ``w`` (counted
    tokens) and ``extra`` (others that its prefix may need)."""
    names = ["doc_id", "n", "s", "wc", "w", "extra"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for b in batches:
            n, s, wc, w, extra = [], [], [], [], []
            for tokens in shingler.sets(b.column("text")):
                mask = _watched(tokens, percent)
                seen = tokens[mask]
                size = len(tokens)
                prefix = size - _least_overlap(size, percent) + 1
                more = np.sort(tokens[~mask])[: max(0, prefix - len(seen))]
                n.append(size)
                s.append(set_key(tokens))
                wc.append(len(seen))
                w.append(seen.tobytes())
                extra.append(more.tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(s, pa.binary()), pa.array(wc, pa.int64()),
                 pa.array(w, pa.binary()), pa.array(extra, pa.binary())], names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_type}, n long, s binary, wc long, w binary, extra binary")


def _postings(sets: DataFrame, *columns: str) -> DataFrame:
    """``token, row`` of the tokens (bytes) in ``columns``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("row").to_numpy()
            for lo in range(0, len(rows), 500):
                part = b.slice(lo, 500)
                lists = [np.frombuffer(b"".join(x), np.int64) for x in zip(*(
                    (v.as_buffer() for v in part.column(c)) for c in columns))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(lists)), pa.array(np.repeat(rows[lo:lo + 500], [len(x) for x in lists]))],
                    ["token", "row"])

    return sets.select("row", *columns).mapInArrow(run, "token long, row long")


def _shared(sets: DataFrame, *columns: str) -> DataFrame:
    """Per row the tokens that other rows have too, with their frequency:
    ``row, toks, dfs`` (arrays, bounded by the document)."""
    counts = write_table(
        _postings(sets, *columns).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "join-counts")
    release(sets.sparkSession)
    hits = _postings(sets, *columns).join(counts, "token")
    lists = hits.groupBy("row").agg(F.collect_list(F.struct("df", "token")).alias("found"))
    lists = write_table(
        lists.select("row", F.col("found.token").alias("toks"), F.col("found.df").alias("dfs")), "join-shared")
    drop_tables(counts)
    release(sets.sparkSession)
    return lists


def _first_postings(sets: DataFrame, percent: int) -> DataFrame:
    """Step 1: ``token, row`` of the shortest prefixes, under the order of
    counted tokens, without tokens that one document alone has."""
    lists = _shared(sets, "w", "extra")
    rows = lists.join(sets.select("row", "n", "wc", "extra"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out_row, out_token = [], []
            for row, toks, dfs, n, wc, extra in zip(
                    *(b.column(c) for c in ("row", "toks", "dfs", "n", "wc", "extra"))):
                tokens = toks.values.to_numpy().view(np.uint64)
                df, n, wc = dfs.values.to_numpy(), n.as_py(), wc.as_py()
                prefix = n - _least_overlap(n, percent) + 1
                mask = _watched(tokens, percent)
                order = np.lexsort((tokens[mask], df[mask]))
                alone = wc - int(mask.sum())
                take = tokens[mask][order][: max(0, prefix - alone)]
                others = np.frombuffer(extra.as_buffer(), np.uint64)[: max(0, prefix - wc)]
                take = np.concatenate([take, others[np.isin(others, tokens[~mask])]])
                out_token.append(take)
                out_row.append(np.full(len(take), row.as_py(), np.int64))
            if out_row:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_token).view(np.int64)), pa.array(np.concatenate(out_row))],
                    ["token", "row"])

    return rows.mapInArrow(run, "token long, row long")


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``row, n, toks`` (bytes) of the wanted sets (``row, s, rep``), from
    the texts of their representatives."""
    near = docs.join(
        wanted.select(F.col("rep").alias("__rep")).distinct(), F.col("doc_id").eqNullSafe(F.col("__rep")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for b in batches:
            sets = list(shingler.sets(b.column("text")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()),
                 pa.array([x.tobytes() for x in sets], pa.binary())], ["s", "n", "toks"])

    found = near.select("text").mapInArrow(run, "s binary, n long, toks binary")
    return found.join(wanted.select("row", "s"), "s").dropDuplicates(["row"]).select("row", "n", "toks")


def _adaptive_postings(full: DataFrame, percent: int) -> DataFrame:
    """Step 2: ``token, row, n, c, l, p``: prefixes of the chosen length;
    ``c`` is the number of tokens that other documents have too, ``p`` the
    token's place among them.  The cost of a length is estimated for
    partners of equal size: their postings, and candidates to verify."""
    rows = _shared(full, "toks").join(full.select("row", "n"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for row, toks, dfs, n in zip(*(b.column(c) for c in ("row", "toks", "dfs", "n"))):
                tokens, df, n = toks.values.to_numpy(), dfs.values.to_numpy(), n.as_py()
                c = len(tokens)
                need = _least_overlap(n, percent)
                if c < need:
                    continue
                order = np.lexsort((tokens, df))
                tokens, met = tokens[order], np.concatenate([[0], np.cumsum(df[order] - 1)])
                alike = -(-(2 * percent * n) // (100 + percent))  # overlap with a set of equal size
                best = None
                for l in range(1, min(MAX_MATCHES, need) + 1):
                    cost = met[min(c, max(0, c - alike + l))] * (1 + VERIFY_COST / l)
                    if best is None or cost < best[0]:
                        best = (cost, l)
                l = best[1]
                m = min(c, c - need + l)
                parts.append((tokens[:m], row.as_py(), n, c, l))
            if parts:
                sizes = [len(p[0]) for p in parts]
                spread = [np.repeat(np.array([p[i] for p in parts], np.int64), sizes) for i in (1, 2, 3, 4)]
                place = np.concatenate([np.arange(k, dtype=np.int64) for k in sizes])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([p[0] for p in parts])), *map(pa.array, spread), pa.array(place)],
                    ["token", "row", "n", "c", "l", "p"])

    return rows.mapInArrow(run, "token long, row long, n long, c long, l long, p long")


def verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those ``x, y`` of ``pairs`` whose full sets reach the threshold."""
    sets = full.select("row", "toks")
    joined = (
        pairs.join(sets.withColumnsRenamed({"row": "x", "toks": "tx"}), "x")
        .join(sets.withColumnsRenamed({"row": "y", "toks": "ty"}), "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for tx, ty in zip(b.column("tx"), b.column("ty")):
                x, y = np.frombuffer(tx.as_buffer(), np.uint64), np.frombuffer(ty.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [b.column("x").filter(pa.array(keep)), b.column("y").filter(pa.array(keep))], ["x", "y"])

    return joined.select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long")


def _star_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """Step 3: each document with its commonest pivot of each kind."""
    own = F.struct((F.col("n") - F.col("c")).alias("p"), "row", "n", "c")
    pivots = [F.min(own).alias("a0")]
    for k in range(1, PIVOTS):
        pivots.append(F.min(F.struct(F.xxhash64("row", F.lit(k)).alias("p"), "row", "n", "c")).alias(f"a{k}"))
    of_list = postings.groupBy("token").agg(F.count(F.lit(1)).alias("size"), *pivots).where("size > 1")
    tried = postings.join(of_list, "token").select(
        "row", "n", "c", F.posexplode(F.array(*[F.col(f"a{k}") for k in range(PIVOTS)])).alias("k", "a"))
    tried = tried.where(
        (F.col("row") != F.col("a.row")) & _may_link(F.col("n"), F.col("c"), F.col("a.n"), F.col("a.c"), percent))
    counted = tried.groupBy("row", "k", F.col("a.row").alias("pivot")).agg(F.count(F.lit(1)).alias("m"))
    best = counted.groupBy("row", "k").agg(F.max(F.struct("m", "pivot")).alias("b"))
    return best.select(
        F.least("row", "b.pivot").alias("x"), F.greatest("row", "b.pivot").alias("y")).distinct()


def _cross_pairs(postings: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Step 4: pairs of different components that share enough prefix
    tokens."""
    comp = postings.join(labels, "row", "left").withColumn("comp", F.coalesce("label", "row")).drop("label")
    sizes = comp.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m"))
    lists = sizes.groupBy("token").agg(
        F.count(F.lit(1)).alias("comps"), F.max(F.struct("m", "comp")).alias("b")).where("comps > 1")
    marked = write_table(
        comp.join(lists.select("token", F.col("b.comp").alias("main")), "token")
        .withColumn("odd", F.col("comp") != F.col("main")).drop("main"), "join-marked")
    x = marked.where("odd").select("token", *[F.col(c).alias(f"x_{c}") for c in ("row", "n", "c", "l", "p", "comp")])
    y = marked.select("token", *[F.col(c).alias(f"y_{c}") for c in ("row", "n", "c", "l", "p", "comp", "odd")])
    need = F.least("x_l", "y_l")

    def in_prefix(side: str) -> Column:
        # Place below c - o + need, o the least overlap of sets of these
        # sizes: o <= k is percent (nx + ny) <= (100 + percent) k.
        k = F.col(f"{side}_c") - F.col(f"{side}_p") - 1 + need
        return percent * (F.col("x_n") + F.col("y_n")) <= (100 + percent) * k

    met = x.join(y, "token").where(
        (F.col("x_comp") != F.col("y_comp")) & (~F.col("y_odd") | (F.col("x_row") < F.col("y_row")))
        & _may_link(F.col("x_n"), F.col("x_c"), F.col("y_n"), F.col("y_c"), percent)
        & in_prefix("x") & in_prefix("y"))
    return (
        met.groupBy(F.least("x_row", "y_row").alias("x"), F.greatest("x_row", "y_row").alias("y"))
        .agg(F.count(F.lit(1)).alias("m"), F.min(F.least("x_l", "y_l")).alias("l"))
        .where("m >= l").select("x", "y"))


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), empty_if_null(F.col(f"`{text_col}`")).alias("text"))
    spark = docs.sparkSession
    base = write_table(
        set_table(docs, k, percent).withColumn("row", F.monotonically_increasing_id()), "join-base")
    # One vertex per set: its first row; rep is an id whose text has it.
    known = base.where("n > 0")
    vertices = write_table(
        known.groupBy("s").agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row"),
                               F.min("doc_id").alias("rep")), "join-vertices")
    one = write_table(
        known.select("row", "n", "wc", "w", "extra").join(vertices.select("row"), "row", "left_semi"), "join-sets")

    first = write_table(_first_postings(one, percent), "join-first")
    met = first.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("token")
    wanted = write_table(
        first.join(met, "token").select("row").distinct().join(vertices, "row").select("row", "s", "rep"), "join-wanted")
    drop_tables(one, first)
    release(spark)
    full = write_table(_full_sets(docs, wanted, k), "join-full")
    release(spark)
    postings = write_table(_adaptive_postings(full, percent), "join-postings")

    links = write_table(verified(_star_pairs(postings, percent), full, percent), "join-links")
    labels = components(links)
    rest = write_table(verified(_cross_pairs(postings, labels, percent), full, percent), "join-links")
    if not rest.isEmpty():
        labels = components(links.unionByName(rest))
    drop_tables(full, postings)
    release(spark)

    named = vertices.join(labels, "row", "left").withColumn("label", F.coalesce("label", "row"))
    smallest = named.groupBy("label").agg(
        F.min("rep").alias("component_id"), F.sum("copies").alias("size")).where("size > 1")
    of_set = write_table(named.join(smallest, "label").select("s", "component_id", F.lit(1).alias("in")), "join-named")
    return base.select("doc_id", "n", "s").join(of_set, "s", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("in").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
