"""Main text of web pages: boosted trees over nodes, hierarchical decoding.

1. ``training_nodes``: a bounded sample of ``MAX_PAGES`` pages (by hash of
   the id) whose authors marked an ``<article>`` or ``<main>``; their nodes
   inside and outside are the two classes (elements around it are left
   out).  Each such page is used as it is and in rewritten layouts, in
   which neutral elements with typical class words take the place of the
   marked ones and sidebars, notices, adverts, forms and comments are
   added; layouts filled with invented words are always included.
2. A gradient-boosted tree classifier (Spark ML) is fitted to the node
   features: tag, attribute words, depth, place, subtree text, density,
   links, punctuation, and the siblings beside.
3. Every page is parsed in full and decoded as a tree: a node is outside
   (then all below it is), inside (parts below may be outside), or a mere
   wrapper (only around others, from the top).  The choice with the largest
   sum of log odds is taken, so no kept node lies below a dropped one.

Defined results
---------------
* null and empty html and pages without text give an empty text, 0 chars.
* unclosed, truncated and very long pages are parsed as far as they go;
  repeated rows are extracted each; an empty table gives an empty result;
  other columns are ignored.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import empty_if_null, write_table
from .dom import FEATURES, THEMES, Page, node_features

MAX_PAGES = 200
INVENTED_PAGES = 40
TREES, DEPTH = 20, 4
MARKED = ("article", "main")
OUTSIDE = frozenset("nav header footer aside form button".split())
BAD_THEMES = frozenset(k for k in THEMES if k != "main")


# ----------------------------------------------------------------- training


def labels(page: Page) -> list[int]:
    """1 inside a marked element, 0 outside, -1 for elements around it."""
    n = len(page.tag)
    if not any(t in MARKED for t in page.tag):
        return [-1] * n
    out = [0] * n
    themes = [{t for t, words in THEMES.items() for w in page.words[i] if w in words.split()} for i in range(n)]
    for i in range(1, n):
        p = page.parent[i]
        if page.tag[i] in MARKED and out[p] != 1:
            out[i] = 1
            while p >= 0:
                out[p], p = -1, page.parent[p]
        elif out[p] == 1:
            unlike = page.tag[i] in OUTSIDE or (themes[i] & BAD_THEMES and "main" not in themes[i])
            out[i] = 0 if unlike else 1
    return out


def _layout(rng: random.Random, main: list[str], other: list[str]) -> str:
    """A page in an invented layout; the text is given as blocks."""
    def word(theme: str) -> str:
        return rng.choice(THEMES[theme].split())

    def some(k: int) -> str:
        return html.escape(" ".join(rng.choice(other).split()[:k]) or "more")

    def box(theme: str, inner: str, tag: str = "div") -> str:
        name = rng.choice(["class", "class", "id"])
        return f'<{tag} {name}="{word(theme)}{rng.choice(["", "-box", " wide", "-1"])}">{inner}</{tag}>'

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{some(rng.randint(1, 4))}</a></li>' for i in range(k)) + "</ul>"

    def side() -> str:
        kind = rng.choice(["side", "ad", "note", "talk", "form", "share"])
        inner = {
            "side": lambda: "<h3>" + some(3) + "</h3>" + links(rng.randint(2, 8)),
            "ad": lambda: some(rng.randint(3, 25)),
            "note": lambda: "<p>" + some(rng.randint(5, 30)) + "</p><button>" + some(2) + "</button>",
            "talk": lambda: "<h3>" + some(2) + "</h3>" + "".join(
                box("talk", "<p>" + some(rng.randint(3, 40)) + "</p>") for _ in range(rng.randint(1, 5))),
            "form": lambda: "<form><label>" + some(2) + "</label><input name=q><button>" + some(1) + "</button></form>",
            "share": lambda: links(rng.randint(2, 5)),
        }[kind]()
        return box(kind, inner, rng.choice(["div", "div", "section", "aside"]))

    body = []
    for k, b in enumerate(main):
        tag = "h1" if k == 0 and rng.random() < 0.7 else rng.choice(["p"] * 8 + ["h2", "blockquote", "li"])
        block = f"<{tag}>{html.escape(b)}</{tag}>"
        body.append("<ul>" + block + "</ul>" if tag == "li" else block)
        if rng.random() < 0.06:
            body.append(box(rng.choice(["ad", "share", "side"]), some(rng.randint(2, 15))))
    # "main" marks the place for the labels; decoding never sees the mark.
    inner = "".join(body)
    attr = rng.choice([f' class="{word("main")}"', f' id="{word("main")}"', "", ""])
    top = rng.choice([
        lambda: "<nav>" + links(rng.randint(3, 9)) + "</nav>",
        lambda: box("menu", links(rng.randint(3, 9))),
        lambda: "<header><h2>" + some(4) + "</h2>" + links(rng.randint(2, 6)) + "</header>",
        lambda: box("head", some(5) + links(rng.randint(2, 6)))])()
    foot = rng.choice([
        lambda: "<footer>" + some(rng.randint(4, 20)) + "</footer>",
        lambda: box("foot", "<p>" + some(rng.randint(4, 20)) + "</p>")])()
    before, after = [side() for _ in range(rng.randint(0, 2))], [side() for _ in range(rng.randint(0, 3))]
    kind = rng.choice(["div", "div", "section", "td"])
    wrapped = f"<main{attr} data-as={kind}>{inner}</main>"
    if rng.random() < 0.4:
        wrapped = "<div>" + wrapped + (after.pop() if after else "") + "</div>"
    return (f"<html><head><title>{some(5)}</title></head><body>{top}{''.join(before)}{wrapped}{''.join(after)}"
            f"{foot}</body></html>")


def _rewritten(rng: random.Random, main: list[str], other: list[str]) -> tuple[Page, list[int]]:
    """An invented layout parsed with its labels; the marked element gets a
    neutral tag afterwards, in the tree itself."""
    page = Page(_layout(rng, main, other))
    marks = labels(page)
    kind = rng.choice(["div", "div", "section", "td", "article"])
    page.tag = [kind if t == "main" else t for t in page.tag]
    return page, marks


def _invented(rng: random.Random) -> list[str]:
    def name() -> str:
        return "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))

    def sentence() -> str:
        return " ".join(name() for _ in range(rng.randint(4, 18))).capitalize() + "."

    return [" ".join(sentence() for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(3, 25))]


def _rows(page: Page, marks: list[int]) -> Iterator[tuple[float, list[float]]]:
    features = node_features(page)
    for i, mark in enumerate(marks):
        if mark >= 0:
            yield float(mark), features[i].tolist()


def training_nodes(pages: DataFrame, html_col: str, id_col: str, max_pages: int, seed: int) -> DataFrame:
    """``label, features`` (array) of the sample's nodes, written."""
    spark = pages.sparkSession
    schema = "label double, features array<double>"
    sample = (
        pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
        .where(F.col("html").rlike("(?i)<(article|main)[ >]"))
        .orderBy(F.xxhash64("id"), "id").limit(max_pages)
    )

    def of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rng, rows = random.Random(seed), []
            for text in b.column("html").to_pylist():
                page = Page(text)
                marks = labels(page)
                rows += _rows(page, marks)
                main, other = [], []
                for _, node, part in page.segments:
                    if part.strip():
                        (main if marks[node] == 1 else other).append(part)
                if main and other:
                    for _ in range(2):
                        rows += _rows(*_rewritten(rng, main, other))
            yield _training_batch(rows)

    def of_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k in b.column("id").to_pylist():
                rng = random.Random(seed * 1_000_003 + k)
                rows += _rows(*_rewritten(rng, _invented(rng), _invented(rng)))
            yield _training_batch(rows)

    invented = spark.range(0, INVENTED_PAGES, 1, 1).mapInArrow(of_seeds, schema)
    return write_table(sample.mapInArrow(of_pages, schema).unionByName(invented), "html-training")


def _training_batch(rows: list[tuple[float, list[float]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))],
        ["label", "features"])


def fit(nodes: DataFrame, seed: int = 7) -> list[tuple]:
    """Boosted trees as ``(weight, feature, threshold, left, right, value)``
    arrays."""
    model = GBTClassifier(
        labelCol="label", featuresCol="v", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed,
        maxBins=32, cacheNodeIds=False,
    ).fit(nodes.select("label", array_to_vector("features").alias("v")))
    return [(w, *_arrays(tree._java_obj.rootNode())) for w, tree in zip(model.treeWeights, model.trees)]


def _arrays(root) -> tuple[np.ndarray, ...]:
    feature, threshold, left, right, value = [], [], [], [], []
    todo = [root]
    for node in todo:  # grows while it is walked
        value.append(float(node.prediction()))
        if node.subtreeDepth() == 0:
            feature.append(-1)
            threshold.append(0.0)
            left.append(len(feature) - 1)
            right.append(len(feature) - 1)
        else:
            feature.append(int(node.split().featureIndex()))
            threshold.append(float(node.split().threshold()))
            left.append(len(todo))
            right.append(len(todo) + 1)
            todo += [node.leftChild(), node.rightChild()]
    return (np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value))


# ----------------------------------------------------------------- decoding


def log_odds(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for weight, feature, threshold, left, right, value in trees:
        at = np.zeros(len(x), int)
        for _ in range(DEPTH):
            f = feature[at]
            go = (f >= 0) & (x[rows, np.maximum(f, 0)] > threshold[at])
            at = np.where(go, right[at], left[at])
        total += weight * value[at]
    return 2 * total


def decode(page: Page, odds: np.ndarray) -> np.ndarray:
    """Which nodes are inside: the best consistent choice over the tree.  The
    page itself is a wrapper, or inside where most text lies on it bare."""
    n = len(page.tag)
    out = -odds.copy()  # the whole subtree outside
    inside, wrapper = odds.copy(), np.zeros(n)
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        out[p] += out[i]
        inside[p] += max(inside[i], out[i])
        wrapper[p] += max(wrapper[i], inside[i], out[i])
    state = np.zeros(n, np.int8)  # 0 outside, 1 inside, 2 wrapper
    state[0] = 1 if page.bare_share() >= 0.5 else 2
    for i in range(1, n):
        above = state[page.parent[i]]
        if above == 1:
            state[i] = inside[i] > out[i]
        elif above == 2:
            best = max(wrapper[i], inside[i], out[i])
            state[i] = 0 if out[i] == best else 1 if inside[i] == best else 2
    return state == 1


def extract(text: str, trees: list[tuple]) -> str:
    if not text:
        return ""
    page = Page(text)
    if not page.segments:
        return ""
    return page.text(decode(page, log_odds(trees, node_features(page))))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      max_pages: int = MAX_PAGES, seed: int = 7, trees: list[tuple] | None = None) -> DataFrame:
    """Per page ``page_id, url, text, n_chars``; ``trees`` of an earlier
    ``fit`` may be given."""
    if trees is None:
        trees = fit(training_nodes(pages, html_col, id_col, max_pages, seed), seed)
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), empty_if_null(F.col(html_col)).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(t.as_py(), trees) for t in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
