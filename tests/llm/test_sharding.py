from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest

from storeflow.llm.sharding import shard_documents

from .helpers import clashing, frame, odd_docs, rows_of


def check_law(got, rows, shards):
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def homes(got):
    out = defaultdict(set)
    for r in got:
        out[r["hub"]].add(r["shard"])
    return out


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_hazards(spark, shards):
    rows = odd_docs()
    check_law(rows_of(shard_documents(clashing(frame(spark, rows)), shards)), rows, shards)


def test_equal_texts_meet_and_hot_groups_spread_over_few_shards(spark):
    rows = [(i, f"text {i}", "en", "s", 1) for i in range(1600)]
    rows += [(2000 + i, f"group {i % 60}", "en", "s", 1) for i in range(600)]
    rows += [(5000 + i, "hot", "en", "s", 1) for i in range(1100)]
    got = rows_of(shard_documents(frame(spark, rows).repartition(9), 8))
    check_law(got, rows, 8)
    size = Counter(r["hub"] for r in got)
    spread = homes(got)
    small = [h for h, n in size.items() if 1 < n < 100]
    assert sum(len(spread[h]) == 1 for h in small) >= 0.9 * len(small)
    hot = max(size, key=size.get)
    assert len(spread[hot]) <= 6  # 1100 of 3300 rows, 412 a shard


def test_fewer_rows_than_shards_and_empty(spark):
    rows = [(1, "a", "en", "s", 1), (2, "a", "en", "s", 1), (None, None, None, None, None)]
    check_law(rows_of(shard_documents(frame(spark, rows), 8)), rows, 8)
    assert rows_of(shard_documents(frame(spark, []), 8)) == []


def test_only_repeated_rows(spark):
    rows = [(7, "same", "en", "s", 1)] * 50
    check_law(rows_of(shard_documents(frame(spark, rows), 4)), rows, 4)


def test_groups_that_fit_stay_whole_on_a_copy_heavy_table(spark):
    sizes = [2] * 120 + [5] * 40 + [30] * 8 + [110] * 2 + [1] * 100
    texts = [f"text {k}" for k, n in enumerate(sizes) for _ in range(n)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = rows_of(shard_documents(frame(spark, rows).repartition(5), 8))
    check_law(got, rows, 8)
    assert not [h for h, s in homes(got).items() if len(s) > 1]  # quota: 125
