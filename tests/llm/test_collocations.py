from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from storeflow.llm import collocations as module
from storeflow.llm.collocations import HatTrie, PhraseCounter, collocations

from .helpers import clashing, frame, odd_docs, rows_of
from .test_exact_dedup import norm


def brute(rows, max_words=3, min_count=10, inside=50, top=2000):
    f = Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split("[.,;:!?\x0A-\x0D]", norm(r[1])):
            w = re.findall("[^\x20\x09]+", piece)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    n = Counter()
    for (lang, p), c in f.items():
        if len(p) == 1:
            n[lang] += c
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    out = {}
    for (lang, p), a in found.items():
        longer = [b for (other, q), b in found.items() if other == lang and len(q) > len(p)
                  and any(q[i:i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= inside * a for b in longer):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                for k in range(1, len(p))]
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s)
                  for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top]))


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rows_of(df))


def some_docs(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["é", "the", "The", "a\x1cb", "\x00", "x" * 300]
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?"])
                       for _ in range(rng.randint(0, 120)))
        yield (1000 + i, text, rng.choice(["en", "en", "de", None, "und"]), "s", 1)


@pytest.mark.parametrize("seed,entries,burst,words,hot", [(1, 10**6, 4096, 500_000, 1024), (2, 40, 3, 500_000, 4), (3, 40, 3, 8, 10**6)])
def test_against_plain_counts(spark, monkeypatch, seed, entries, burst, words, hot):
    for name, value in (("ENTRIES", entries), ("BURST", burst), ("WORDS", words), ("HOT", hot), ("RUN_BYTES", 500), ("ROWS_OUT", 7)):
        monkeypatch.setattr(module, name, value)
    rows = odd_docs() + list(some_docs(seed))
    docs = clashing(frame(spark, rows)).repartition(3)
    want = brute(rows, min_count=3)
    assert len(want) > 50 and got(collocations(docs, min_count=3)) == want


def test_two_words_other_limits_and_top(spark):
    rows = list(some_docs(4))
    docs = frame(spark, rows)
    assert got(collocations(docs, max_words=2, min_count=2, top=5)) == brute(rows, 2, 2, top=5)
    assert got(collocations(docs, min_count=2, inside_percent=101)) == brute(rows, 3, 2, inside=101)
    with pytest.raises(ValueError):
        collocations(docs, max_words=4)


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000
    cand = frame(spark, [("en", "x y", big, ["x", "y"])], "lang string, phrase string, a long, words array<string>")
    parts = frame(spark, [("en", "x", big + 1), ("en", "y", big + 7)], "lang string, phrase string, f long")
    row = rows_of(module._scored(cand, parts))[0]
    assert row["score"] == 1_000_000 * big * big // ((big + 1) * (big + 7))


def test_trie_counts_like_a_counter():
    rng = np.random.default_rng(2)
    for length, burst in ((2, 5), (3, 5), (3, 10**6)):
        trie, plain, out = HatTrie(length, burst), Counter(), Counter()
        for _ in range(20):
            ids = rng.integers(1, 9, (200, length))
            key = ids[:, 0]
            for j in range(1, length):
                key = key << module.ID_BITS | ids[:, j]
            keys, counts = np.unique(key, return_counts=True)
            trie.add(keys, counts)
            plain.update(key.tolist())
            if trie.entries > 40:
                k, n = trie.spill(20)
                assert (np.diff(k) > 0).all() and trie.entries <= 20
                out.update(dict(zip(k.tolist(), n.tolist())))
        assert trie.entries == sum(map(len, trie.containers)) and trie.starts == sorted(trie.starts)
        if burst == 5:
            # Spans begin at whole subtrees and are small unless one prefix fills them.
            assert len(trie.starts) >= 7 and all(s % (1 << module.ID_BITS) == 0 for s in trie.starts)
            assert all(len(c) <= 10 or len({k >> module.ID_BITS for k in c}) <= 2 for c in trie.containers)
        k, n = trie.spill(0)
        out.update(dict(zip(k.tolist(), n.tolist())))
        assert out == plain and trie.starts == [0]


def test_word_hash_is_sparks(spark):
    row = spark.sql("SELECT xxhash64('dé', 'wörd') AS h").first()
    everything = np.full((1 << 26) // 8, 255, np.uint8)
    counter = PhraseCounter(2, everything, None, frozenset(), 100, 10)
    assert counter._number("dé".encode(), {"wörd".encode()}) == {b".": 0, "wörd".encode(): 1}
    assert row["h"] & (1 << 64) - 1 == int(counter.hashes[1])


def test_empty(spark):
    assert got(collocations(frame(spark, []))) == []
