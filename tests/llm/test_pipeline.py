"""The pipeline against a brute-force version made of the stages' own."""

from __future__ import annotations

import importlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as cp
from storeflow.llm import pii, quality

from . import test_pii as pii_brute
from . import test_quality as quality_brute
from .helpers import frame, odd_docs, rows_of
from .test_exact_dedup import norm
from .test_ngram_join import words_set


def corpus():
    rng = random.Random(11)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(quality_brute.texts(5, 260))]
    for i in range(60):
        source = rng.choice(rows[:260])
        words = source[1].split(" ")
        if rng.random() < 0.5 and len(words) > 150:
            words[rng.randrange(len(words))] = "changed"
        text = " ".join(words)
        rows.append((1000 + i, text.upper() if rng.random() < 0.3 else text, "en", "s", len(text)))
    mail = rows[3][1] + " und.34@mail7.example.com 4111111111111111 tail"
    rows.append((3000, " ".join(f"unlike{i}" for i in range(80)) + " " + mail[-60:], "en", "s", 1))
    return rows + rows[20:23] + odd_docs()


def kept_by_brute(rows):
    stats, far = quality_brute.brute(rows)
    rows = [r for r, s, d in zip(rows, stats, far) if not s[5] and d <= quality.CUTOFF]
    best = {}
    for r in rows:
        best.setdefault(norm(r[1]), r)
        if (r[0] is not None, r[0]) > (best[norm(r[1])][0] is not None, best[norm(r[1])][0]):
            best[norm(r[1])] = r
    rows = list(best.values())
    sets = [words_set(r[1], 5) for r in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r)
    return [min(g, key=lambda r: (r[0] is not None, r[0])) for g in groups.values()]


def test_stages(spark, tmp_path):
    rows = corpus()
    want = kept_by_brute(rows)
    docs, sizes = frame(spark, rows), []
    for name, stage in cp.STAGES[:4]:
        columns = docs.columns
        path = str(tmp_path / name)
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] == len(want)
    pii_brute.KEY, key = pii.DEFAULT_KEY, pii_brute.KEY
    try:
        expected = Counter((r[0], pii_brute.brute(r[1])[0]) for r in want)
    finally:
        pii_brute.KEY = key
    got = rows_of(docs)
    assert Counter((r["doc_id"], r["text"]) for r in got) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    packed = rows_of(cp.STAGES[4][1](spark, docs, ""))
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in got}
    assert sum(r["length"] for r in packed) > 0 and all(len(r["ids"]) == r["length"] for r in packed)


def test_empty_table(spark):
    docs = frame(spark, [])
    for _, stage in cp.STAGES:
        out = stage(spark, docs, "")
        assert rows_of(out) == []
        docs = out if "text" in out.columns else docs


def test_a_column_of_the_row_names_own_name_is_carried_along(spark):
    docs = frame(spark, corpus()[:60]).withColumn("__name", F.lit("x")).withColumn("__name_", F.lit("y"))
    for _, stage in cp.STAGES[:3]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert {(r["__name"], r["__name_"]) for r in rows_of(out)} <= {("x", "y")}


def test_run_is_registered():
    entry = importlib.import_module("__spark_entry__")
    assert "pipeline" in entry.queries()
    assert [n for n in entry.queries() if n.startswith("op")] == [n for n in entry.llm.QUERIES]
