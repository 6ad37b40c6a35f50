from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from storeflow.llm import near_dedup
from storeflow.llm.bloom import bloom_filter, may_hold
from storeflow.llm.near_dedup import Signer, chunk_choices, close_in_block, key_sizes, least_distance, near_duplicates

from .helpers import clashing, frame, odd_docs, rows_of
from .test_ngram_join import brute, near_docs


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(df)), key=repr)


@pytest.mark.parametrize("positions,distance,errors", [(12, 5, 0), (12, 5, 1), (10, 3, 2), (6, 6, 1), (4, 9, 1)])
def test_every_pair_within_the_distance_shares_a_key(positions, distance, errors):
    choices = chunk_choices(positions, distance, errors)
    assert all(choices)
    for differ in combinations(range(positions), min(distance, positions - 1)):
        if distance < positions:
            assert any(not set(differ) & set(c) for c in choices)


def test_distance_follows_from_the_miss_rate():
    # direct sum of the binomial tail
    from math import comb
    for positions, percent, miss in ((64, 80, 1e-5), (32, 90, 1e-3), (64, 100, 1e-5)):
        d, p = least_distance(positions, percent, miss), 1 - percent / 100
        tail = [sum(comb(positions, i) * p ** i * (1 - p) ** (positions - i) for i in range(k + 1, positions + 1))
                for k in (d - 1, d)]
        assert tail[1] <= miss + 1e-12 and (d == 0 or tail[0] > miss - 1e-12)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    x, y = np.unique(pool[:2500]), np.unique(pool[500:])
    sig = Signer(4096, 16).sign([x, np.empty(0, np.uint64), y])
    similar = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((sig[0] == sig[2]).mean() - similar) < 0.03 and not sig[1].any()


def test_bloom_holds_all_keys(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS h")
    own = np.array([r["h"] for r in keys.collect()], np.int64)
    bits = bloom_filter(keys, keys["h"])
    assert may_hold(bits, own).all() and may_hold(bits, own ^ np.int64(12345)).mean() < 0.01
    assert not may_hold(bloom_filter(keys.limit(0), keys["h"]), own).any()


@pytest.mark.parametrize("seed,k,percent,errors", [(1, 2, 80, 1), (2, 5, 80, 0), (3, 1, 70, 1), (4, 2, 100, 1)])
def test_against_all_pairs(spark, seed, k, percent, errors):
    rows = near_docs(seed) + [(10**6 + (r[0] or 0) if r[0] is not None else None, *r[1:]) for r in odd_docs()]
    docs = clashing(frame(spark, rows)).repartition(7)
    assert got(near_duplicates(docs, k, percent, errors=errors)) == brute(rows, k, percent)


@pytest.mark.parametrize("small,tokens", [(32, 1_000_000), (2, 300), (10**6, 1)])
def test_without_star_links_pairs_and_blocks_find_all(spark, monkeypatch, small, tokens):
    monkeypatch.setattr(near_dedup, "SMALL_KEY", small)
    monkeypatch.setattr(near_dedup, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(near_dedup, "_star_pairs", lambda s, percent, distance, closest: s.select(
        s["row"].alias("x"), s["row"].alias("y")).limit(0))
    rows = near_docs(5)
    assert got(near_duplicates(frame(spark, rows), 2, 80)) == brute(rows, 2, 80)


def test_kept_is_one_row_per_component(spark):
    rows = [(7, "a b c d", "en", "s", 1), (3, "A b c d", "en", "s", 1), (5, "other words here", "en", "s", 1),
            (None, "a b c d", "en", "s", 1), (9, None, "en", "s", 1), (None, "alone", "en", "s", 1)]
    kept = {(r["doc_id"], r["component_id"]): r["kept"] for r in rows_of(near_duplicates(frame(spark, rows), 2))}
    assert kept == {(7, 3): False, (3, 3): True, (5, 5): True, (None, 3): False, (9, 9): True, (None, None): True}


def test_empty(spark):
    assert rows_of(near_duplicates(frame(spark, []))) == []


def _members(seed, n):
    rng = random.Random(seed)
    base = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(5)]
    out = []
    for row in range(n):
        s0, s1 = base[rng.randrange(5)] if rng.random() < 0.6 else (rng.getrandbits(63), rng.getrandbits(63))
        out.append((row * 7, rng.choice([50, 60, 100]), s0 ^ 1 << rng.randrange(62), s1, rng.randrange(n)))
    return out


def _parts(links):
    label = {}
    for x, y in links:
        x, y = label.setdefault(x, x), label.setdefault(y, y)
        for k in [k for k, v in label.items() if v == max(x, y)]:
            label[k] = min(x, y)
    return label


def _close(members, percent, distance):
    return [(x[4], y[4]) for x, y in combinations(members, 2)
            if x[4] != y[4] and 100 * min(x[1], y[1]) >= percent * max(x[1], y[1])
            and (x[2] ^ y[2] | x[3] ^ y[3]).bit_count() <= distance]


@pytest.mark.parametrize("seed", [1, 2])
def test_a_block_connects_what_its_close_pairs_connect(seed):
    members = _members(seed, 150)
    table = pa.table({c: [m[i] for m in members * 2] for i, c in enumerate(("row", "n", "s0", "s1", "comp"))})
    got_links = close_in_block(table.append_column("is_x", pa.array([True] * 150 + [False] * 150)), 80, 20)
    pairs = list(zip(got_links["x"].to_pylist(), got_links["y"].to_pylist()))
    assert len(pairs) < 150 and _parts(pairs) == _parts(_close(members, 80, 20)) != {}


def test_only_close_members_of_a_large_key_make_a_cluster(spark, monkeypatch):
    # One key that all share by chance: as one cluster all would meet all by
    # their full sets, which grows with the square of the rows.
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 16)
    members = _members(3, 120)
    rows = [(1, *m, 120, m[4] != 0, sum(m[4] != 0 for m in members)) for m in members]
    shared = spark.createDataFrame(
        rows, "key long, row long, n long, s0 long, s1 long, comp long, size long, odd boolean, others long")
    clusters = {r["row"]: r["cluster"] for r in near_dedup._clusters(shared, 80, 20).collect()}
    parts = _parts(_close(members, 80, 20))
    assert clusters == {m[0]: parts[m[4]] for m in members if m[4] in parts} and len(clusters) < 120


def test_key_sizes_count_each_vertex(spark):
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 3, (300, 6)).astype(np.uint16)
    choices = [(0, 1), (2, 3), (4, 5)]
    docs = spark.createDataFrame([(r.tobytes(),) for r in sig], "sig binary").repartition(5)
    sizes = sorted(r["size"] for r in key_sizes(docs, 6, choices).collect())
    assert sizes == sorted(n for c in choices for n in np.unique(sig[:, c], axis=0, return_counts=True)[1])


def test_long_texts_reach_the_workers_in_small_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(name), []
    table = near_dedup.write_table
    monkeypatch.setattr(near_dedup, "write_table", lambda df, of: seen.append(spark.conf.get(name)) or table(df, of))
    rows_of(near_duplicates(frame(spark, near_docs(6)[:20]), 2, 80))
    assert {int(x) for x in seen} == {4 << 20} and spark.conf.get(name) == before
