from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from storeflow.llm import spelling
from storeflow.llm.fm_index import FmIndex
from storeflow.llm.spelling import Router, near_words, roots, spelling_groups, vocabulary

from .helpers import clashing, frame, odd_docs, rows_of
from .test_exact_dedup import norm

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_vocabulary(rows, min_length, min_count, drop_every):
    n = Counter()
    for doc, text, *_ in rows:
        for run in RUN.findall(norm(text)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if drop_every and h % drop_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}


def brute_groups(n, ratio=5):
    out = {}
    for w in n:
        others = [v for v in n if v != w and near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        out[w] = [best if best and n[best] >= ratio * n[w] else None, len(others)]
    rows = []
    for w, (form, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n[w], k, n[form] if form else None))
    return sorted(rows)


def got(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows_of(df))


def some_words(rng, size, letters="abé", longest=9):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(2, longest))) for _ in range(size)})


@pytest.mark.parametrize("seed", range(12))
def test_index_finds_each_near_word_once(seed):
    rng = random.Random(seed)
    words = some_words(rng, rng.choice([1, 2, 60, 250]))
    index = FmIndex.load(FmIndex(words, np.arange(len(words))).dump())
    asked = words + ["zzzzzz", "abzab", "zb", "a" * 300]
    found = []
    for first in (True, False):
        q, place = index.one_error(asked, first)
        pairs = list(zip(q.tolist(), place.tolist()))
        assert len(set(pairs)) == len(pairs)
        if not first:
            pairs = [(i, p) for i, p in pairs if not words[p].startswith(asked[i][:len(asked[i]) // 2])]
        found += pairs
    assert sorted(found) == [(i, p) for i, w in enumerate(asked) for p, v in enumerate(words) if v != w and near(w, v)]


def test_routes_miss_no_block():
    rng = random.Random(3)
    words = some_words(rng, 400, "ab")
    for size in (1, 3, 50):
        blocks = [(k, words[i], words[min(i + size, len(words)) - 1]) for k, i in enumerate(range(0, len(words), size))]
        router = Router(blocks)
        for w in words:
            h = len(w) // 2
            to = set(router.blocks(w, h))
            for i, v in enumerate(words):
                if v != w and near(w, v) and v.startswith(w[:h]):
                    assert i // size in to


@pytest.mark.parametrize("block_words", [7, 1 << 16])
def test_against_all_pairs(spark, monkeypatch, block_words):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(spelling, "CHUNK_CHARS", 50)
    rng = random.Random(block_words)
    # a third of the words share one long beginning
    words = some_words(rng, 200) + ["hotbeginning" + w for w in some_words(rng, 120, "ab", 6)]
    n = {w: rng.choice([1, 2, 5, 25, 125, 700]) for w in words}
    table = frame(spark, [(w, k, "x") for w, k in n.items()], "word string, n long, best string")
    assert got(spelling_groups(table)) == brute_groups(n)


def texts(rng):
    words = some_words(rng, 60, "abcé", 8)
    for i in range(60):
        yield " ".join(rng.choice(words) + rng.choice(["", ".", "1"]) for _ in range(rng.randint(0, 60)))


@pytest.mark.parametrize("drop_every", [None, 3])
def test_whole_operator_on_odd_texts(spark, monkeypatch, drop_every):
    monkeypatch.setattr(spelling, "TABLE_WORDS", 20)
    rng = random.Random(9)
    rows = odd_docs() + [(1000 + i, t, "en", "s", 1) for i, t in enumerate(texts(rng))]
    rows += [(5000, "Straßenbahn STRASSENBAHN strassenbahn naïvement Naïvement x×y ÷ ÿÿÿÿÿÿ " * 5, None, None, None)]
    n = brute_vocabulary(rows, 4, 3, drop_every)
    assert len(n) > 40
    docs = clashing(frame(spark, rows)).repartition(5)
    assert got(spelling_groups(vocabulary(docs, 4, 3, drop_every))) == brute_groups(n)


def test_roots_of_a_long_chain(spark):
    forms = frame(spark, [(f"w{i:02}", f"w{i + 1:02}") for i in range(30)], "word string, form string")
    assert {r["root"] for r in rows_of(roots(forms))} == {"w30"}


def test_empty(spark):
    assert got(spelling_groups(vocabulary(frame(spark, [])))) == []
    assert rows_of(near_words(frame(spark, [], "word string, n long"))) == []
