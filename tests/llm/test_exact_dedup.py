from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from storeflow.llm.exact_dedup import exact_dedup

from .helpers import clashing, frame, odd_docs, rows_of


def norm(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, best):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    out = []
    for r in rows:
        ids = groups[norm(r[1])]
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        out.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows_of(df)), key=repr)


@pytest.mark.parametrize("bits", [128, 8])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_hazards_and_collisions(spark, bits, keep):
    rows = odd_docs() + [(1000 + i, f"text {i % 700}", "en", "s", 1) for i in range(1400)]
    docs = clashing(frame(spark, rows))
    assert got(exact_dedup(docs, keep=keep, hash_bits=bits)) == brute(rows, {"smallest": min, "largest": max}[keep])


def test_hot_group_is_compared_in_salts(spark):
    rows = [(i, "Hot" if i % 3 else f"t{i}", "en", "s", 1) for i in range(3000)]
    assert got(exact_dedup(frame(spark, rows), keep="largest")) == brute(rows, max)


def test_empty(spark):
    assert rows_of(exact_dedup(frame(spark, []))) == []
