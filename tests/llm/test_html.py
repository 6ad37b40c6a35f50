from __future__ import annotations

import html
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from storeflow.llm.dom import FEATURES, Page, node_features
from storeflow.llm.html_extract import _invented, _rewritten, decode, extract_main_text, fit, log_odds, training_nodes

from .helpers import clashing, frame, rows_of

DDL = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def trees(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    return fit(training_nodes(pages, "html", "page_id", 40, 7))


def article(text):
    """The article of a test page by its tags: blocks end at any tag but b."""
    inner = text.partition("<article>")[2]
    inner = re.split("</article>|<footer>", inner)[0]
    inner = re.sub("</?b>", "", inner)
    blocks = (" ".join(html.unescape(b).split()) for b in re.split("<[^>]*>", inner))
    return " ".join(b for b in blocks if b)


def test_test_pages(spark, trees):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in rows_of(extract_main_text(clashing(pages), trees=trees))}
    for p in rows_of(pages):
        r = got[p["page_id"]]
        assert r["text"] == article(p["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == p["url"]


def test_held_out_layouts(trees):
    """Layouts of another seed: nodes inside and outside are told apart."""
    right = total = 0
    for seed in range(40):
        rng = random.Random(900_000 + seed)
        page, marks = _rewritten(rng, _invented(rng), _invented(rng))
        chosen = decode(page, log_odds(trees, node_features(page)))
        for _, node, text in page.segments:
            if marks[node] >= 0:
                right += len(text) * (chosen[node] == (marks[node] == 1))
                total += len(text)
    assert right >= 0.95 * total


def test_decoding_is_consistent_and_best():
    """Against all labellings of small trees."""
    from itertools import product

    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(2, 6)
        page = Page("")
        page.tag, page.parent = ["#page"] + ["div"] * (n - 1), [-1] + [rng.randrange(i) for i in range(1, n)]
        odds = np.array([0.0] + [rng.uniform(-2, 2) for _ in range(n - 1)])
        best = -1e9
        for states in product((0, 1, 2), repeat=n - 1):
            s = (2, *states)
            ok = all(s[page.parent[i]] != 0 or s[i] == 0 for i in range(1, n)) and all(
                s[i] != 2 or s[page.parent[i]] == 2 for i in range(1, n))
            if ok:
                best = max(best, sum(o if x == 1 else -o if x == 0 else 0 for o, x in zip(odds[1:], states)))
        chosen = decode(page, odds)
        for i in range(1, n):  # no kept node below a dropped one, unless a wrapper chain leads to it
            p = page.parent[i]
            if chosen[i] and p and not chosen[p]:
                while p:
                    assert not chosen[p]
                    p = page.parent[p]
        value = max(_value(chosen, odds, page, n))
        assert value == pytest.approx(best)


def _value(chosen, odds, page, n):
    """Values of the labellings with these kept nodes."""
    from itertools import product

    free = [i for i in range(1, n) if not chosen[i]]
    for pick in product((0, 2), repeat=len(free)):
        s = [1 if c else 0 for c in chosen]
        s[0] = 2
        for i, x in zip(free, pick):
            s[i] = x
        if all(s[page.parent[i]] != 0 or s[i] == 0 for i in range(1, n)) and all(
                s[i] != 2 or s[page.parent[i]] == 2 for i in range(1, n)):
            yield sum(o if x == 1 else -o if x == 0 else 0 for o, x in zip(odds[1:], s[1:]))


def test_parsing():
    page = Page("<div><p>a<b>b</b> c<p>d &amp; e&copy;<br>f<!-- no --><script>var x='<p>no</p>'</script></div>g<title>no")
    assert page.text([True] * len(page.tag)) == "ab c d & e© f g"
    assert len(FEATURES) == node_features(page).shape[1]
    page = Page("<ul><li>one<li>two</ul><table><tr><td>x<td>y<tr><td>z</table>" + "<div>" * 3000 + "deep")
    assert page.text([True] * len(page.tag)) == "one two x y z deep"


def test_hazards(spark, trees):
    rows = [
        (1, "u", None), (2, None, ""), (3, "u", "no tags at all"), (4, "u", "<"), (5, "u", "<p"), (6, "u", "</p></div>"),
        (7, "u", "<article>" + "<p>long text here. " * 30000), (None, "u", "<html><body></body></html>"),
        (8, "u", "<script>never closed"), (8, "u", "<script>never closed"), (9, "u", "\x00<a\x00b>"),
        (10, "u", "<nav><a href=/>x</a></nav><article><h1>Title of it</h1><p>Some real text, long enough.</p></article>"),
    ]
    got = rows_of(extract_main_text(clashing(frame(spark, rows, DDL)), trees=trees))
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == by[8] == by[None] == ""
    assert by[7] == " ".join(["long text here."] * 30000)
    assert by[10] == "Title of it Some real text, long enough."
    assert rows_of(extract_main_text(frame(spark, [], DDL))) == []


def test_long_pages_take_linear_time():
    for piece in ("<i></b>", "<i><h1>", "<p><select><i><h1>", "</div>", "<li><b>"):
        pages = [piece * (n // len(piece)) for n in (100_000, 1_000_000)]
        took = []
        for page in pages:
            begin = time.process_time()
            Page(page)
            took.append(time.process_time() - begin)
        assert took[1] < 25 * max(took[0], 0.05), (piece, took)


def test_bare_text_is_kept_and_open_comments_go(spark, trees):
    pages = ["Just some text without any markup at all.", "Text <b>bold</b> and more of it <br> here.", "before <!-- never closed <p>x</p>",
             "<div><p>A page.</p></div><!--", "", "<!-- only -->"]
    rows = [(i, f"u{i}", p) for i, p in enumerate(pages)]
    out = {r["page_id"]: r["text"] for r in rows_of(extract_main_text(
        frame(spark, rows, DDL), trees=trees))}
    assert out[0] == pages[0] and out[1] == "Text bold and more of it here." and out[2] == "before"
    assert "<!--" not in out[3] and out[4] == out[5] == ""
