"""Base statistics and the robust estimates against plain Python / numpy."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from storeflow.llm import quality as q

from .helpers import clashing, frame, odd_docs, rows_of

WORD = re.compile("[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i:i + 8])].append(i)
    covered = {p + j for ps in seen.values() if len(ps) > 1 for p in ps for j in range(8)}
    out = (len(w), sum(map(len, w)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered))
    return (*out, out[0] < 20 or 100 * out[4] > 30 * out[0])


def quantile_bin(bins, share):
    need, cum = math.ceil(share * len(bins)), 0
    for b, n in sorted(Counter(bins).items()):
        cum += n
        if cum >= need:
            return b


def middle(values, share=0.5):
    """The quantile by signed logarithmic bins."""
    b = quantile_bin([int(np.sign(v)) * math.floor(math.log2(1 + 64 * abs(v)) * q.BINS_PER_OCTAVE) for v in values], share)
    return float(np.sign(b)) * (2 ** ((abs(b) + 0.5) / q.BINS_PER_OCTAVE) - 1) / 64 if b else 0.0


FLOORS = np.diag(np.square(q.FLOOR))


def moments(x):
    return x.mean(0), x.T @ x / len(x) - np.outer(x.mean(0), x.mean(0)) + FLOORS


def distances(x, centre, cov):
    return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)


def robust(x, half):
    """Centre and covariance of one group."""
    centre = np.array([middle(c) for c in x.T])
    dev = [middle(np.abs(c - m)) for c, m in zip(x.T, centre)]
    starts = {"median": (centre, np.diag(np.square(1.4826 * np.array(dev))) + FLOORS), "all": moments(x)}
    if half.any():
        starts["half"] = moments(x[half])
    return starts


def step(x, centre, cov):
    bins = np.floor(np.log2(distances(x, centre, cov) + 1e-9) * q.BINS_PER_OCTAVE).astype(int)
    return moments(x[bins <= quantile_bin(bins.tolist(), q.H_SHARE)])


def estimates(groups, x, half):
    """All groups step together, until no determinant falls."""
    now = {(g, s): e for g, ids in groups.items() for s, e in robust(x[ids], half[ids]).items()}
    for _ in range(q.STEPS):
        after = {(g, s): step(x[groups[g]], *e) for (g, s), e in now.items()}
        fallen = any(np.linalg.slogdet(after[k][1])[1] / 2 < np.linalg.slogdet(now[k][1])[1] / 2 - 1e-6 for k in now)
        now = after
        if not fallen:
            break
    out = {}
    for g, ids in groups.items():
        own = [(round(np.linalg.slogdet(now[g, s][1])[1] / 2, 9), k, s) for k, s in enumerate(q.STARTS) if (g, s) in now]
        centre, cov = now[g, min(own)[2]]
        out[g] = moments(x[ids][distances(x[ids], centre, q.CONSISTENCY * (cov - FLOORS) + FLOORS) <= q.REWEIGHT])
    return out


def shrunk(own, above, n, more=0.0):
    w, v = n / (n + q.SHRINK), n / (n + q.SHRINK_COV)
    return w * own[0] + (1 - w) * above[0], v * own[1] + (1 - v) * above[1] + (1 - v) * more


def brute(rows):
    """Distance per row (None: base failed)."""
    stats = [base(r[1]) for r in rows]
    key = [("null" if r[2] is None else "=" + r[2], "null" if r[3] is None else "=" + r[3]) for r in rows]
    ok = [i for i, s in enumerate(stats) if not s[5]]
    s = np.array([stats[i][:5] for i in ok], float)
    bins = [math.floor(math.log2(c / n) * 64) for n, c in s[:, :2]]
    groups = defaultdict(list)
    for k, i in enumerate(ok):
        for g in (("G",), ("L", key[i][0]), ("S", *key[i])):
            groups[g].append(k)
    mid = {g: 2 ** ((quantile_bin([bins[k] for k in ids], 0.5) + 0.5) / 64) for g, ids in groups.items()}
    own = np.array([len(groups["S", *key[i]]) for i in ok])
    own = own / (own + q.SHRINK)
    mids = own * [mid["S", *key[i]] for i in ok] + (1 - own) * [mid["L", key[i][0]] for i in ok]
    n = s[:, 0]
    x = np.column_stack([(s[:, 1] - mids * n) / np.sqrt(n), np.log1p(20 * s[:, 2] / n), np.log1p(s[:, 3]), s[:, 4] / n])
    found = estimates(groups, x, np.floor(np.abs(x[:, 0]) * 8) % 2 == 0)
    langs = [g for g in groups if g[0] == "L"]
    w = np.array([len(groups[g]) / (len(groups[g]) + q.SHRINK) for g in langs])
    between = np.diag(sum(k * (found[g][0] - found["G",][0]) ** 2 for k, g in zip(w, langs)) / w.sum())
    out = [None] * len(rows)
    for g, ids in groups.items():
        if g[0] == "S":
            lang = shrunk(found["L", g[1]], found["G",], len(groups["L", g[1]]), between)
            for k, d in zip(ids, distances(x[ids], *shrunk(found[g], lang, len(ids)))):
                out[ok[k]] = d
    return stats, out


def texts(seed, n):
    rng = random.Random(seed)
    for i in range(n):
        size = rng.choice([3, 25, 60, 200, 700])
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) for _ in range(size)]
        kind = rng.random()
        if kind < 0.08:
            words = [w + rng.choice(["***", "$$$", "%%%"]) for w in words]
        elif kind < 0.12:
            words = words[:12] * 9
        elif kind < 0.2:
            words += ["\n" + " ".join(words[:5])] * 3
        yield " ".join(words)


def table():
    rng = random.Random(9)
    rows = [(i, t, "en", "hot" if i % 3 else rng.choice(["a", "b", None]), 1) for i, t in enumerate(texts(1, 900))]
    rows += [(2000 + i, t, rng.choice(["de", None]), f"s{i % 30}", 1) for i, t in enumerate(texts(2, 250))]
    return rows + [(r[0] if r[0] is None else 9000 + r[0], *r[1:]) for r in odd_docs()]


def test_against_numpy(spark, monkeypatch):
    rows = table()
    # The third start's half by a statistic that both sides know.
    monkeypatch.setattr(q, "_half", lambda: F.pmod(F.floor(F.abs(F.col("x1")) * 8), F.lit(2)) == 0)
    got = rows_of(q.quality_rules(clashing(frame(spark, rows)).repartition(6)))
    stats, far = brute(rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = defaultdict(list)
    for r, s, d in zip(rows, stats, far):
        want[r[0]].append((s, d))
    assert len(got) == len(rows)
    for r in got:
        own = tuple(r[c] for c in names)
        same = [d for s, d in want[r["doc_id"]] if s == own]
        assert same, (r["doc_id"], own, want[r["doc_id"]])
        if r["base_failed"]:
            assert r["distance"] is None and not r["kept"]
        else:
            assert any(d == pytest.approx(r["distance"], rel=1e-6, abs=1e-9) for d in same)
            assert r["kept"] == (r["distance"] <= q.CUTOFF)
    kept = {r["doc_id"] for r in got if r["kept"]}
    junk = [r[0] for r, s in zip(rows, stats) if not s[5] and s[2] > s[0]]
    clean = [r[0] for r, s in zip(rows, stats) if not s[5] and not s[2] and not s[4] and r[0] is not None and r[0] < 9000]
    assert junk and not kept & set(junk)
    assert sum(i in kept for i in clean) >= 0.99 * len(clean)


def test_few_or_no_documents(spark):
    assert rows_of(q.quality_rules(frame(spark, []))) == []
    one = rows_of(q.quality_rules(frame(spark, [(1, "word " * 30, "en", "s", 1), (2, " ".join(map(str, range(30))), "en", "s", 1)])))
    assert {r["doc_id"]: r["kept"] for r in one} == {1: False, 2: True}
    assert [r["kept"] for r in rows_of(q.quality_rules(frame(spark, [(1, "too short", "en", "s", 1)])))] == [False]


def rare_languages():
    """Clean documents of rare languages with unlike word lengths, and junk."""
    rng = random.Random(4)

    def words(low, high, n):
        return ["".join(rng.choice("abcdefg") for _ in range(rng.randint(low, high))) for _ in range(n)]

    sizes = {"xx": (5, 10, 92), "yy": (2, 5, 20), "zz": (1, 3, 3)}
    rows = [(f"{lang}{i}", " ".join(words(low, high, rng.randint(60, 400))), lang, f"s{i % 3}", 1)
            for lang, (low, high, n) in sizes.items() for i in range(n)]
    junk = [(f"junk {lang}{i}", " ".join(w + "***" for w in words(low, high, 150)), lang, "s0", 1)
            for lang, (low, high, n) in sizes.items() if n >= 20 for i in range(2)]
    return rows, junk


def test_unlike_rare_languages_keep_their_clean_documents(spark):
    rows, junk = rare_languages()
    got = rows_of(q.quality_rules(frame(
        spark, rows + junk, "doc_id string, text string, lang string, source string, n_chars long")))
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert kept == {r[0] for r in rows}
    assert all(r["distance"] is not None for r in got if not r["base_failed"])


@pytest.mark.parametrize("small", [1, 4, 16, 40])
def test_a_small_source_is_judged_by_its_language(spark, small):
    """Junk goes from a source of any size; its clean documents stay."""
    rng = random.Random(small)

    def text(junk):
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(80, 300))]
        return " ".join(w + "#*$" if junk and k < 40 else w for k, w in enumerate(words))

    rows = [(f"clean {i}", text(False), "en", "large", 1) for i in range(400)]
    rows += [(f"clean s{i}", text(False), "en", "small", 1) for i in range(small)]
    rows += [(f"junk {i}", text(True), "en", "large" if i % 2 else "small", 1) for i in range(8)]
    got = rows_of(q.quality_rules(frame(
        spark, rows, "doc_id string, text string, lang string, source string, n_chars long")))
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert not [k for k in kept if k.startswith("junk")]
    assert sum(r[0] in kept for r in rows if r[0].startswith("clean")) >= len(rows) - 8 - 2
