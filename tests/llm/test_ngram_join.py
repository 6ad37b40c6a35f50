from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from storeflow.llm import ngram_join
from storeflow.llm.components import components
from storeflow.llm.ngram_join import ngram_jaccard_join
from storeflow.llm.shingles import Shingler

from .helpers import ODD_TEXTS, clashing, frame, odd_docs, rows_of
from .test_exact_dedup import norm

WORD = re.compile("[^\x20\x09-\x0D]+")


def words_set(text, k):
    w = WORD.findall(norm(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k, percent):
    """doc_id, n, component by all pairs."""
    sets = [words_set(r[1], k) for r in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    out = []
    for i, r in enumerate(rows):
        known = [x for x in ids[find(i)] if x is not None]
        out.append((r[0], len(sets[i]), r[0] if not sets[i] else min(known) if known else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(df)), key=repr)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abAB \n\té\x0b", max_size=20), max_size=8), st.integers(1, 4))
def test_sets_have_the_sizes_and_equalities_of_word_sets(texts, k):
    texts = texts + ODD_TEXTS[:9]
    hashed = [tuple(s.tolist()) for s in Shingler(k).sets(pa.array(texts))]
    plain = [words_set(t, k) for t in texts]
    assert [len(h) for h in hashed] == [len(p) for p in plain]
    for i in range(len(texts)):
        for j in range(i):
            assert len(set(hashed[i]) & set(hashed[j])) == len(plain[i] & plain[j])


def test_runs_cut_between_documents(monkeypatch):
    monkeypatch.setattr("storeflow.llm.shingles.RUN_BYTES", 10)
    texts = ["one two three four", "", "five six seven eight nine", "one two three four"]
    sets = list(Shingler(3).sets(pa.array(["skip", *texts]).slice(1)))
    assert [len(s) for s in sets] == [2, 0, 3, 2] and (sets[0] == sets[3]).all()


def edited(rng, words, edits, vocabulary):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return " ".join(words)


def near_docs(seed, n_words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, n_words))]
        for _ in range(rng.choice([1, 1, 2, 5, 20])):
            rows.append((len(rows), edited(rng, base, rng.randint(0, 3), vocabulary), "en", "s", 1))
    # one large group, and one passage in many documents
    base = [rng.choice(vocabulary) for _ in range(80)]
    rows += [(len(rows) + i, edited(rng, base, rng.randint(0, 4), vocabulary), "en", "s", 1) for i in range(120)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(15))
    for i in range(60):
        rows.append((len(rows), passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25))), "en", "s", 1))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 90), (2, 5, 80), (3, 1, 70), (4, 2, 100)])
def test_against_all_pairs(spark, seed, k, percent):
    rows = near_docs(seed) + [(10**6 + (r[0] or 0) if r[0] is not None else None, *r[1:]) for r in odd_docs()]
    docs = clashing(frame(spark, rows)).repartition(7)
    assert got(ngram_jaccard_join(docs, k, percent)) == brute(rows, k, percent)


def test_without_star_links_the_cross_pairs_find_all(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_star_pairs", lambda p, percent: p.select(
        p["row"].alias("x"), p["row"].alias("y")).limit(0))
    rows = near_docs(5)
    assert got(ngram_jaccard_join(frame(spark, rows), 3, 90)) == brute(rows, 3, 90)


def test_longer_prefixes_are_chosen_and_needed_matches_follow(spark):
    full = frame(spark, [(i, 40, np.arange(i % 3, 40 + i % 3, dtype=np.uint64).tobytes()) for i in range(60)],
                 "row long, n long, toks binary")
    chosen = {r["l"] for r in rows_of(ngram_join._adaptive_postings(full, 80))}
    assert max(chosen) > 1


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "x long, y long")
    labels = {r["row"]: r["label"] for r in rows_of(components(links))}
    assert labels == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_empty(spark):
    assert rows_of(ngram_jaccard_join(frame(spark, []))) == []
