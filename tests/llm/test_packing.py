from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from storeflow.llm.packing import best_fit_plan, pack_documents
from storeflow.llm.queries import tokenizer

from .helpers import clashing, frame, odd_docs, rows_of


def simulate(lengths, capacity):
    """Best fit, longest first, one piece at a time: number of sequences."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_whole_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 2048])
    top = rng.choice([capacity, capacity // 3 + 1])
    lengths = [rng.randint(1, top) for _ in range(rng.randint(0, 400))]
    counts = dict(Counter(lengths))
    plan, opened = best_fit_plan(counts, capacity)
    used, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, per, offset in plan.tolist():
        for j in range(n):
            ranks[length].append(rank + j)
            used[first + j // per].append((offset + j % per * length, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items()}
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(used) == list(range(opened))
    assert opened <= simulate(lengths, capacity)


def test_plan_refuses_long():
    with pytest.raises(ValueError):
        best_fit_plan({9: 1}, 8)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_documents(spark, capacity):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rows = odd_docs() + [(5000 + i, "equal length", "en", "s", 1) for i in range(300)]
    docs = clashing(frame(spark, rows)).repartition(4)
    got = rows_of(pack_documents(docs, tokenizer("byte_bpe_50k.json"), 0, capacity, with_ids=True))
    want = Counter()
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            want[r[0], k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes()), tuple(ids[lo:hi])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) <= simulate([r["length"] for r in got], capacity)


def test_empty(spark):
    assert rows_of(pack_documents(frame(spark, []), tokenizer("byte_bpe_50k.json"))) == []
