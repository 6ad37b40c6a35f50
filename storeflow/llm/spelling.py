"""Spelling variants of a corpus vocabulary, by bidirectional FM-indexes.

Two words are near when they differ by exactly one inserted, deleted or
replaced code point.  One error leaves one half of a word whole: either the
first half stands at the beginning of its near word or the second half at
its end.  The search scheme therefore matches one half exactly and extends
the match across the other half allowing one error; two schemes, one per
half, find every near word.

1. *Vocabulary.*  Tasks count the words of their texts in bounded tables;
   one shuffle adds the counts up.
2. *Blocks.*  For the first scheme the vocabulary is range-sorted by word,
   for the second by reversed word, into blocks of about ``BLOCK_WORDS``
   words.  The task of a block builds its FM-index (``fm_index``) and writes
   it to the shared folder; the table of blocks holds first and last words.
3. *Routes.*  Words that share a word's exact half are neighbours in the
   block order, so a word is sent only to the blocks whose range its half
   (or, where many blocks share the half, the half and what follows with
   one error) can reach.  Sent words are range-sorted by block, so many
   words for one block are spread over tasks and each task loads an index
   once.
4. *Search.*  Per word and block a task returns the number of near words
   and the best one, never the pairs.  What the second scheme finds is
   dropped if the first half stands unchanged too: the first scheme has it.
5. *Forms and roots.*  A word's form is its near word of largest count, if
   at least ``ratio`` times as frequent; roots follow the forms by pointer
   jumping (counts grow along a chain, so there are no cycles).

Defined results
---------------
* null text and text without words add nothing; an empty table or
  vocabulary gives an empty result.
* rows without an id count like others (their id is written as nothing in
  the deletion rule of ``vocabulary``); repeated rows count again.
* texts and words of any length are taken whole; ties between near words of
  equal count go to the smallest in code-point order; other columns are
  ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import parallelism
from .blobs import new_file, open_read, open_write
from .common import drop_folder, drop_tables, new_folder, write_table
from .fm_index import FmIndex

LETTERS = "A-Za-zÀ-ÿ"
BLOCK_WORDS = 1 << 16
MAX_BLOCKS = 4096  # the table of blocks reaches driver and tasks; beyond, blocks grow
TABLE_WORDS = 400_000  # distinct words that a task counts before it passes them on
QUERIES_PER_TASK = 1 << 15
CHUNK_CHARS = 20_000  # code points searched for in lockstep


def vocabulary(docs: DataFrame, min_length: int = 6, min_count: int = 5, drop_every: int | None = None,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: maximal runs of ``LETTERS``, A-Z lower-cased, of at least
    ``min_length`` code points that occur ``min_count`` times or more.

    With ``drop_every`` a run loses one code point where ``drop_every``
    divides the crc32 of ``<id>:<run>``: that at the crc32 modulo the run's
    length.
    """
    run_of = re.compile(f"[{LETTERS}]{{{min_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def pass_on():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return batch

        for b in batches:
            for doc, text in zip(b.column("id").to_pylist(), b.column("text")):
                if not text.is_valid:
                    continue
                # bytes.lower maps A-Z only
                runs = Counter(run_of.findall(text.as_buffer().to_pybytes().lower().decode(errors="replace")))
                if drop_every:
                    start = zlib.crc32(f"{doc}:".encode())
                    for run, n in runs.items():
                        h = zlib.crc32(run.encode(), start)
                        if h % drop_every == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1:]
                            if len(run) < min_length:
                                continue
                        total[run] += n
                else:
                    total.update(runs)
                if len(total) > TABLE_WORDS:
                    yield pass_on()
        yield pass_on()

    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = rows.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _half(word: str) -> int:
    return len(word) // 2


def _blocks(words: DataFrame, total: int, folder: str, first: bool) -> DataFrame:
    """Index files of the vocabulary in the order of one scheme: ``first,
    lo, hi`` (first and last key of the block), ``uri, size``."""
    key = F.col("word") if first else F.reverse("word")
    blocks = min(MAX_BLOCKS, math.ceil(total / BLOCK_WORDS))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        block = pa.Table.from_batches(parts).sort_by("word")
        own = block.column("word").to_pylist()
        data = FmIndex(own, block.column("n").to_numpy()).dump()
        uri = new_file(folder, ".fm")
        with open_write(uri) as out:
            out.write(data)
        keys = own if first else [w[::-1] for w in own]
        yield pa.RecordBatch.from_arrays(
            [pa.array([first]), pa.array([min(keys)]), pa.array([max(keys)]), pa.array([uri]), pa.array([len(data)])],
            ["first", "lo", "hi", "uri", "size"])

    return words.repartitionByRange(blocks, key).mapInArrow(
        build, "first boolean, lo string, hi string, uri string, size long")


def _begins_within_one(prefix: str, word: str, exact: int) -> bool:
    """Whether a word that one error after ``exact`` code points of ``word``
    makes can begin with ``prefix``."""
    k = len(commonprefix([prefix, word]))
    if k == len(prefix):
        return True
    if k < exact:
        return False
    return (word.startswith(prefix[k + 1:], k + 1) or word.startswith(prefix[k + 1:], k)
            or word.startswith(prefix[k:], k + 1))


class Router:
    """Which blocks of one scheme a word is searched in."""

    def __init__(self, blocks: list[tuple[int, str, str]]):
        blocks = sorted(blocks, key=lambda b: b[1])
        self.ids = [b[0] for b in blocks]
        self.los, self.his = [b[1] for b in blocks], [b[2] for b in blocks]
        self.common = [commonprefix([lo, hi]) for lo, hi in zip(self.los, self.his)]

    def blocks(self, key: str, exact: int) -> list[int]:
        part = key[:exact]
        a, b = bisect_left(self.his, part), bisect_right(self.los, part + "\U0010FFFF")
        if b - a == 1:
            return [self.ids[a]]
        return [self.ids[i] for i in range(a, b) if _begins_within_one(self.common[i], key, exact)]


def _routed(words: DataFrame, blocks: list) -> DataFrame:
    """``block, word`` for every block in which a word may have near ones."""
    forward = [(k, b["lo"], b["hi"]) for k, b in enumerate(blocks) if b["first"]]
    backward = [(k, b["lo"], b["hi"]) for k, b in enumerate(blocks) if not b["first"]]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, back = Router(forward), Router(backward)
        for b in batches:
            own, to = [], []
            for word in b.column("word").to_pylist():
                h = _half(word)
                found = ahead.blocks(word, h) + back.blocks(word[::-1], len(word) - h)
                own += [word] * len(found)
                to += found
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(own, pa.string())], ["block", "word"])

    return words.select("word").mapInArrow(route, "block int, word string")


def _searched(routed: DataFrame, blocks: list) -> DataFrame:
    """``word, near, less, best``: near words found in one block, and the
    most frequent one (``less`` is its count, negated)."""
    files = {k: (b["first"], b["uri"]) for k, b in enumerate(blocks)}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, first = None, None, None
        for b in batches:
            block, words = b.column("block").to_numpy(), b.column("word").to_pylist()
            lo = 0
            while lo < len(words):
                hi, chars = lo, 0
                while hi < len(words) and block[hi] == block[lo] and chars < CHUNK_CHARS:
                    chars += len(words[hi])
                    hi += 1
                if at != block[lo]:
                    at = int(block[lo])
                    first, uri = files[at]
                    with open_read(uri) as f:
                        index = FmIndex.load(f.read())
                yield _best(index, words[lo:hi], first)
                lo = hi

    return routed.mapInArrow(search, "word string, near long, less long, best string")


def _best(index: FmIndex, words: list[str], first: bool) -> pa.RecordBatch:
    q, place = index.one_error(words, first)
    if not first and len(q):
        other = np.array([not index.words[p].startswith(words[i][:_half(words[i])])
                          for i, p in zip(q.tolist(), place.tolist())], bool)
        q, place = q[other], place[other]
    order = np.lexsort((place, -index.counts[place], q))
    q, place = q[order], place[order]
    head = np.flatnonzero(np.diff(q, prepend=-1))
    own, top = q[head], place[head]
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in own.tolist()], pa.string()),
         pa.array(np.diff(np.append(head, len(q))).astype(np.int64)), pa.array(-index.counts[top].astype(np.int64)),
         pa.array([index.words[p] for p in top.tolist()], pa.string())], ["word", "near", "less", "best"])


def near_words(words: DataFrame) -> DataFrame:
    """``words``: a written table of distinct ``word``s (two code points at
    least) with ``n``.  Per word that has near ones: ``word, n_near, best,
    best_n``."""
    spark = words.sparkSession
    total = words.count()
    folder = new_folder(spark, "spelling-index")
    blocks: list = []
    if total:
        both = [write_table(_blocks(words, total, folder, first), "spelling-blocks") for first in (True, False)]
        blocks = [b for t in both for b in t.collect()]  # at most 2 * MAX_BLOCKS rows
        drop_tables(*both)
    routed = write_table(_routed(words, blocks), "spelling-routed")
    tasks = max(parallelism(spark), math.ceil(routed.count() / QUERIES_PER_TASK))
    spread = routed.repartitionByRange(tasks, "block", "word").sortWithinPartitions("block", "word")
    found = write_table(
        _searched(spread, blocks).groupBy("word")
        .agg(F.sum("near").alias("n_near"), F.min(F.struct("less", "best")).alias("top"))
        .select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n")), "spelling-near")
    drop_tables(routed)
    drop_folder(spark, folder)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """``word, form`` (no cycles) to ``word, root``: the last word that the
    forms lead to."""
    at = write_table(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = write_table(
            at.join(further, "root", "left").select(
                "word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")),
            "spelling-roots")
        moved = after.where("moved").limit(1).count()
        drop_tables(at)
        at = after.select("word", "root")
        if not moved:
            return at


def spelling_groups(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``words``: ``word, n``.  One row per word: ``word, form, root, n,
    n_near, form_n``."""
    words = write_table(words.select("word", "n"), "spelling-words")
    found = words.join(near_words(words), "word", "left")
    led = F.col("best_n") >= ratio * F.col("n")
    named = write_table(
        found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                     F.when(led, F.col("best")).alias("form"), F.when(led, F.col("best_n")).alias("form_n")),
        "spelling-forms")
    end = roots(named.where("form IS NOT NULL"))
    return named.join(end, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
