"""Phrase collocations per language, counted in hash-array tries.

Texts are split into pieces at ``. , ; : ! ?`` and line ends, pieces into
words at spaces and tabs.  A candidate is a phrase of two to ``max_words``
words that occurs ``min_count`` times in its language.  Its score compares
the count with those of its two parts at the worst cut; a candidate is
dropped where a longer one around it is nearly as frequent.

Counting, one pass per phrase length:

1. A task numbers the words that it meets and that the pass before found
   often enough (a Bloom filter of fixed size; what it lets through in
   excess is counted too and sorted out later).  Windows over other words,
   or whose shorter parts are too rare, are never formed.
2. Windows are counted in a shallow trie of word ids whose leaves are hash
   containers.  A container holds a span of first words, or, under one first
   word, a span of second words; beyond ``BURST`` entries it bursts into two
   at the middle word.  When the trie holds ``ENTRIES`` entries, the largest
   whole subtrees leave it as sorted runs.
3. Runs are merged per prefix partition: a phrase goes to the partition of
   its first word, or, where that word makes more than a ``1 / HOT`` part of
   all words (at most ``HOT`` words of all languages together), to that of
   the whole phrase.

Sums, products and scores are exact: products run in ``decimal(38)``, and
an overflow (counts beyond some 10^15) raises.

Defined results
---------------
* null and empty texts and pieces without words add nothing; null languages
  are ``und``; an empty table gives an empty result.
* whole texts of any length are counted; repeated rows count again; rows
  without an id count like others; other columns are ignored.
* equal scores are ordered by count, then by the phrase's UTF-8 bytes;
  equally low cuts go to the shortest first part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import bloom_filter, may_hold
from .common import drop_tables, empty_if_null, write_table

ID_BITS = 21  # of a word id within a task; three make a key
ENTRIES = 1_500_000
BURST = 32_768
WORDS = 500_000  # words that a task numbers before it begins anew
RUN_BYTES = 1 << 22
ROWS_OUT = 100_000
HOT = 1024
PARTS = 1 << 20
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _byte_table() -> bytes:
    out = bytearray(range(256))
    for c in range(65, 91):
        out[c] += 32
    for c in b".,;:!?\x0a\x0b\x0c\x0d":
        out[c] = ord(".")
    out[9] = 32
    return bytes(out)


# A-Z lower-cased, separators of pieces to ".", tabs to spaces.
TABLE = _byte_table()


def tokens_of(text: bytes) -> list[bytes]:
    """The words of a text, with ``.`` between pieces."""
    return text.translate(TABLE).replace(b".", b" . ").split()


def joined_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    h = (first * MIX_A) ^ second
    h = (h ^ (h >> np.uint64(32))) * MIX_B
    return h ^ (h >> np.uint64(29))


class HatTrie:
    """Counts of phrases of ``length`` (2 or 3) word ids, packed into one
    integer each, the first word highest.

    Leaves are hash containers over spans of the trie's prefixes: ``starts``
    holds the first key of each span, which is that of a whole subtree (a
    first word, or a first and second one).
    """

    def __init__(self, length: int, burst: int):
        self.shifts = [ID_BITS * (length - 1 - depth) for depth in range(length - 1)]
        self.burst = burst
        self.starts, self.containers, self.entries = [0], [{}], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add sorted distinct keys."""
        edges = [*np.searchsorted(keys, self.starts[1:]).tolist(), len(keys)]
        lo = 0
        full = []
        for i, hi in enumerate(edges):
            if hi > lo:
                own = self.containers[i]
                before, get = len(own), own.get
                for key, n in zip(keys[lo:hi].tolist(), counts[lo:hi].tolist()):
                    own[key] = get(key, 0) + n
                self.entries += len(own) - before
                if len(own) > self.burst:
                    full.append(i)
            lo = hi
        for i in reversed(full):
            self._split(i)

    def _split(self, i: int) -> None:
        """Burst container ``i`` into parts of about half of ``burst``, each
        beginning at a word's whole subtree, at the lowest depth that will do;
        one whose keys share all words but the last stays."""
        keys, counts = _sorted_entries([self.containers[i]])
        cuts = [0]
        for middle in range(self.burst // 2, len(keys), max(1, self.burst // 2)):
            for shift in self.shifts:
                at = int(np.searchsorted(keys, keys[middle] >> shift << shift))
                if at > cuts[-1]:
                    cuts.append(at)
                    break
        starts = [self.starts[i]]
        for at in cuts[1:]:
            # The highest subtree that begins between the two keys.
            starts.append(next(int(keys[at]) >> s << s for s in self.shifts if int(keys[at]) >> s << s > int(keys[at - 1])))
        self.starts[i:i + 1] = starts
        self.containers[i:i + 1] = [
            dict(zip(keys[lo:hi].tolist(), counts[lo:hi].tolist())) for lo, hi in zip(cuts, [*cuts[1:], len(keys)])]

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Empty the largest containers until ``keep`` entries are left:
        their keys, sorted, and counts."""
        taken = []
        for i in sorted(range(len(self.containers)), key=lambda i: -len(self.containers[i])):
            if self.entries <= keep:
                break
            taken.append(self.containers[i])
            self.entries -= len(self.containers[i])
            self.containers[i] = {}
        if not self.entries:
            self.starts, self.containers = [0], [{}]
        return _sorted_entries(taken)


def _sorted_entries(containers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    size = sum(map(len, containers))
    key = np.fromiter(chain.from_iterable(containers), np.int64, size)
    count = np.fromiter(chain.from_iterable(c.values() for c in containers), np.int64, size)
    order = np.argsort(key)
    return key[order], count[order]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            yield lang.encode(), text.as_buffer().to_pybytes()


def word_counts(texts: DataFrame) -> DataFrame:
    """``lang, phrase, h, f`` of single words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, Counter] = {}

        def pass_on() -> pa.RecordBatch:
            langs, words, counts = [], [], []
            for lang, own in found.items():
                own.pop(b".", None)
                langs += [lang] * len(own)
                words += own.keys()
                counts += own.values()
            found.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.binary()).view(pa.string()), pa.array(words, pa.binary()).view(pa.string()),
                 pa.array(counts, pa.int64())], ["lang", "phrase", "n"])

        for lang, text in _texts(batches):
            own = found.setdefault(lang, Counter())
            own.update(tokens_of(text))
            if sum(map(len, found.values())) > WORDS:
                yield pass_on()
        yield pass_on()

    counted = texts.mapInArrow(count, "lang string, phrase string, n long")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).select(
        "lang", "phrase", F.xxhash64("lang", "phrase").alias("h"), "f")


def phrase_counts(texts: DataFrame, length: int, words: np.ndarray, shorter: np.ndarray | None,
                  hot: frozenset[int]) -> DataFrame:
    """``lang, phrase, h, f`` of phrases of ``length`` words.

    ``words`` and ``shorter``: Bloom filters of the words and of the phrases
    of one word less that may be parts; ``hot``: hashes of the first words
    whose phrases are dealt out one by one."""
    entries, burst = ENTRIES, BURST

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PhraseCounter(length, words, shorter, hot, entries, burst)
        run, size = [], 0
        for lang, text in _texts(batches):
            run.append((lang, text))
            size += len(text)
            if size > RUN_BYTES:
                yield from counter.add(run)
                run, size = [], 0
        yield from counter.add(run)
        yield from counter.rows(0)

    runs = texts.mapInArrow(count, "part int, lang string, phrase string, h long, n long")
    # The exchange by part serves the grouping too: part is a function of
    # language and phrase.
    return runs.repartition("part").groupBy("part", "lang", "phrase", "h").agg(F.sum("n").alias("f")).drop("part")


class PhraseCounter:
    def __init__(self, length, words, shorter, hot, entries, burst):
        self.length, self.filter, self.shorter, self.hot = length, words, shorter, hot
        self.entries, self.burst = entries, burst
        self._begin()

    def _begin(self) -> None:
        self.trie = HatTrie(self.length, self.burst)
        self.ids: dict[bytes, dict[bytes, int]] = {}  # 0: a break or a word that is no part
        self.names, self.langs, self.hashes = [b""], [b""], np.zeros(1, np.uint64)
        self.met = 0

    def _number(self, lang: bytes, tokens: set[bytes]) -> dict[bytes, int]:
        """The word ids of a language, with those of ``tokens``.  A word's
        hash is Spark's ``xxhash64(lang, word)``, as in ``word_counts``."""
        own = self.ids.setdefault(lang, {b".": 0})
        fresh = list(tokens - own.keys())
        seed = xxhash.xxh64_intdigest(lang, 42)
        hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in fresh], np.uint64)
        known = may_hold(self.filter, hashes.view(np.int64))
        own.update(dict.fromkeys(fresh, 0))
        for i in np.flatnonzero(known).tolist():
            own[fresh[i]] = len(self.names)
            self.names.append(fresh[i])
            self.langs.append(lang)
        self.hashes = np.concatenate([self.hashes, hashes[known]])
        self.met += len(fresh)
        return own

    def add(self, run: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[bytes, list[bytes]] = {}
        for lang, text in run:
            tokens = by_lang.setdefault(lang, [])
            tokens += tokens_of(text)
            tokens.append(b".")
        ids: list[int] = []
        for lang, tokens in by_lang.items():
            ids += map(self._number(lang, set(tokens)).__getitem__, tokens)
        at = np.array(ids, np.int64)
        if len(at) >= self.length:
            key, ok = at[:len(at) - self.length + 1].copy(), np.ones(len(at) - self.length + 1, bool)
            for j in range(self.length):
                word = at[j:len(at) - self.length + 1 + j]
                ok &= word > 0
                if j:
                    key = key << ID_BITS | word
            if self.shorter is not None:
                part = self._hash([at[j:len(at) - self.length + 2 + j] for j in range(self.length - 1)])
                held = may_hold(self.shorter, part.view(np.int64))
                ok &= held[:-1] & held[1:]
            keys, counts = np.unique(key[ok], return_counts=True)
            self.trie.add(keys, counts)
        if self.met > WORDS or len(self.names) > (1 << ID_BITS) - RUN_BYTES // 2:
            yield from self.rows(0)
            self._begin()
        elif self.trie.entries > self.entries:
            yield from self.rows(self.entries // 2)

    def _hash(self, words: list[np.ndarray]) -> np.ndarray:
        out = self.hashes[words[0]]
        for w in words[1:]:
            out = joined_hash(out, self.hashes[w])
        return out

    def rows(self, keep: int) -> Iterator[pa.RecordBatch]:
        """A sorted run of the trie's largest subtrees."""
        keys, counts = self.trie.spill(keep)
        if not len(keys):
            return
        names, langs = pa.array(self.names, pa.binary()), pa.array(self.langs, pa.binary())
        hot = np.isin(self.hashes, np.array(sorted(self.hot), np.uint64))
        low = (1 << ID_BITS) - 1
        for lo in range(0, len(keys), ROWS_OUT):
            own, n = keys[lo:lo + ROWS_OUT], counts[lo:lo + ROWS_OUT]
            words = [own >> ID_BITS * j & low for j in range(self.length - 1, -1, -1)]
            h = self._hash(words)
            part = np.where(hot[words[0]], h, self.hashes[words[0]]) % np.uint64(PARTS)
            phrase = pc.binary_join_element_wise(*[names.take(pa.array(w)) for w in words], b" ")
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), langs.take(pa.array(words[0])).view(pa.string()),
                 phrase.view(pa.string()), pa.array(h.view(np.int64)), pa.array(n)],
                ["part", "lang", "phrase", "h", "n"])


def _scored(candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """``lang, phrase, a, words, l, r, score`` at the lowest cut."""
    cut = candidates.select(
        "lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.select(
        "lang", "phrase", "a", "words", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        known = parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cut = cut.join(known, ["lang", side])
    # DIV divides decimals exactly and cuts off: a floor, as all is positive.
    score = F.expr("""CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))
                      DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))""")
    best = cut.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "a", "words")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.words", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, inside_percent: int = 50,
                 top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r,
    n, score``.  ``max_words`` is 2 or 3."""
    if max_words not in (2, 3):
        raise ValueError("max_words is 2 or 3")
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                        empty_if_null(F.col(f"`{text_col}`")).alias("text"))
    every = write_table(word_counts(texts), "phrase-words")
    totals = write_table(every.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    total = totals.agg(F.sum("n")).first()[0] or 0
    hot = frozenset(r["h"] & (1 << 64) - 1 for r in every.where(F.col("f") * HOT > total).select("h").collect())  # < HOT rows
    often = every.where(F.col("f") >= min_count)
    words = bloom_filter(often, F.col("h"))

    levels, shorter = [], None
    for length in range(2, max_words + 1):
        counted = phrase_counts(texts, length, words, shorter, hot)
        level = write_table(counted.where(F.col("f") >= min_count), f"phrase-{length}")
        levels.append(level)
        if length < max_words:
            shorter = bloom_filter(level, F.col("h"))

    parts = often.select("lang", "phrase", "f")
    for level in levels[:-1]:
        parts = parts.unionByName(level.select("lang", "phrase", "f"))
    candidates = levels[0]
    for level in levels[1:]:
        candidates = candidates.unionByName(level)
    candidates = candidates.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))

    # The most frequent longer candidate around each phrase.
    longer = candidates.where(F.size("words") > 2).select("lang", "a", "words", F.explode(
        F.sequence(F.lit(2), F.size("words") - 1)).alias("k"))
    inside = longer.select("lang", "a", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("words") - F.col("k") + 1),
        lambda i: F.array_join(F.slice("words", i, F.col("k")), " "))).alias("phrase"))
    around = inside.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    left = candidates.join(around, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (100 * F.col("around") < inside_percent * F.col("a")))

    scored = write_table(_scored(left.drop("around"), parts), "phrase-scored")
    drop_tables(*levels)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (
        scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
