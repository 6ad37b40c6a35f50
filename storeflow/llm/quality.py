"""Quality rules: base limits, then robust multivariate outliers.

Every document gets base statistics of its whole text and a vector of
transformed ones.  A minimum-covariance-determinant estimate (centre and
covariance of the ``H_SHARE`` of documents that lie closest) is found by
concentration steps from several starts: distances under the present
estimate, the distance below which the share lies, moments of the documents
within, until no determinant falls any more.  The start with the least
determinant counts; a last step reweights with all documents that are no
outliers.  Documents beyond ``CUTOFF`` (Mahalanobis, squared) are rejected.

Estimates are made at three levels alike, whatever their size: all
documents, each language, each language's source.  A group's estimate is
shrunk towards that of the level above by its count, weight n / (n +
``SHRINK``) for the centre and n / (n + ``SHRINK_COV``) for the covariance
(that of very few documents is not robust): a source of few documents is judged by its language's centre
and covariance over all sources, a large one by its own.  Languages may
have unlike centres, so the spread between languages is added to the
covariance of a language, with the weight that its own estimate lacks.

All of it is grouped DataFrame work on a written narrow table: sums of four
values and their products per group (one partial row per group and task),
and counts per group and distance bin in place of sorting; bins are
logarithmic, so their number is bounded by the range of doubles.  The 4 x 4
covariance is factored in column expressions.

The vector: shifted mean word length (characters beyond the group's median
times the words, over the root of the words: equal spread for short and
long documents), logs of symbols per word and of doubled lines, and the
share of repeated words.  ``FLOOR`` is added to the variances, so a
statistic that is constant in a group does not reject a small change.

Defined results
---------------
* null and empty texts have no words: all statistics 0, base_failed.
* null language or source is a group value of its own.
* rows without an id and repeated rows are judged like others; they count
  as often as they occur.
* repeated words are found by equal 64-bit hashes of word windows; the words
  themselves are not compared.
* an empty table gives an empty result; a group without any document that
  passes the base limits has no estimate, its documents are rejected by
  those limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPACE, empty_if_null, let, write_table

SYMBOLS = "#*$%&|<>"  # fixed value
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SHRINK = 20  # documents that the level above counts for in a centre
SHRINK_COV = 200  # in a covariance, which has ten entries
H_SHARE = 0.75
STEPS = 10  # concentration steps at most; they end when no determinant falls
DIMS = 4
# Smallest standard deviation that a statistic is given.
FLOOR = (1.0, 0.1, 0.5, 0.1)
# Variance of the closest 75 % of a normal variable, inverted: makes the
# concentrated covariance consistent in the least favourable case.
CONSISTENCY = 2.71
REWEIGHT = 11.143  # chi-square of four values, 0.975
CUTOFF = 33.377  # chi-square of four values, 1 - 10^-6
BINS_PER_OCTAVE = 16
STARTS = ("median", "all", "half")


# --------------------------------------------------------- base statistics


def _repeated_words(words: Column, n: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words found twice or more."""
    def places(hashes: Column) -> Column:
        # (hash, place) sorted; a place counts when a neighbour has its hash.
        pairs = F.array_sort(F.transform(hashes, lambda x, k: F.struct(x.alias("h"), k.alias("k"))))
        return let(pairs, repeated)

    def repeated(pairs: Column) -> Column:
        def place(p: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(pairs, i - 1)["h"] == p["h"])
            after = F.get(pairs, i + 1)["h"] == p["h"]
            return F.when(before | after, p["k"])
        return F.array_sort(F.filter(F.transform(pairs, place), lambda k: k.isNotNull()))

    def covered(hashes: Column) -> Column:
        total = F.aggregate(
            places(hashes), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, k: F.struct(
                (a["n"] + F.least(F.lit(WINDOW), k - a["last"])).alias("n"), k.alias("last")),
            lambda a: a["n"])
        doubled = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(doubled, total).otherwise(F.lit(0))

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - WINDOW + 1)
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW))), covered)

    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(let(words, windows))


def base_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed."""
    text = empty_if_null(F.col(f"`{text_col}`"))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("__t"))
    t = F.col("__t")
    rows = rows.withColumn("__w", F.filter(F.split(t, f"[{WORD_SPACE}]+"), lambda w: w != ""))
    bare = F.translate(t, "".join(map(chr, [32, *range(9, 14)])), "")
    n = F.size("__w")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WORD_SPACE}]"))
    return rows.select(
        *[F.col(f"`{c}`") for c in keep],
        n.cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("__w"), n).cast("long").alias("n_repeat_words"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


# --------------------------------------------------------------- estimates


def _text_key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def _quantile_bin(rows: DataFrame, by: list[str], bin_: Column, share: float) -> DataFrame:
    """Per group the lowest bin up to which ``share`` of the rows lie; the
    window orders one row per bin."""
    counts = rows.groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("cum", F.sum("n").over(up_to)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    return counts.where(F.col("cum") >= F.ceil(F.lit(share) * F.col("all"))).groupBy(*by).agg(F.min("bin").alias("bin"))


def _log_bin(c: Column) -> Column:
    return F.floor(F.log2(c + F.lit(1e-9)) * BINS_PER_OCTAVE).cast("int")


def _signed_bin(c: Column) -> Column:
    """Logarithmic to both sides of 0, in steps of 1/64 near it."""
    return (F.signum(c) * F.floor(F.log2(1 + 64 * F.abs(c)) * BINS_PER_OCTAVE)).cast("int")


def _bin_value(b: Column) -> Column:
    """The middle of a signed bin."""
    size = (F.pow(F.lit(2.0), (F.abs(b) + 0.5) / BINS_PER_OCTAVE) - 1) / 64
    return F.when(b == 0, F.lit(0.0)).otherwise(F.signum(b.cast("double")) * size)


X = [f"x{i}" for i in range(1, DIMS + 1)]
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
CENTRE = [f"m{i + 1}" for i in range(DIMS)]
COV = [f"c{i}{j}" for i, j in PAIRS]


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Count ``n``, centre and covariance (without floors) per group."""
    x = [F.col(c) for c in X]
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(m) for c, m in zip(x, CENTRE)]
    aggs += [F.avg(x[i] * x[j]).alias(f"p{i}{j}") for i, j in PAIRS]
    return rows.groupBy(*by).agg(*aggs).select(
        *by, "n", *CENTRE,
        *[(F.col(f"p{i}{j}") - F.col(CENTRE[i]) * F.col(CENTRE[j])).alias(f"c{i}{j}") for i, j in PAIRS])


def _with_floors(estimates: DataFrame, factor: float = 1.0) -> DataFrame:
    return estimates.withColumns({
        f"c{i}{j}": factor * F.col(f"c{i}{j}") + F.lit(FLOOR[i] ** 2 if i == j else 0.0) for i, j in PAIRS})


def _factored(estimates: DataFrame) -> DataFrame:
    """``estimates`` with the Cholesky factor ``l00, l10, ..`` of the
    covariance in place of it, and the log-determinant ``det``."""
    out = estimates
    for j in range(DIMS):
        for i in range(j, DIMS):
            cov = F.col(f"c{i}{j}")
            for k in range(j):
                cov = cov - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            if i == j:
                cov = F.sqrt(F.greatest(cov, F.lit(FLOOR[i] ** 2)))
            else:
                cov = cov / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", cov)
    det = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, DIMS)), F.log("l00"))
    return out.withColumn("det", det).drop(*COV)


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    y: list[Column] = []
    for i in range(DIMS):
        d = F.col(X[i]) - F.col(CENTRE[i])
        for k in range(i):
            d = d - F.col(f"l{i}{k}") * y[k]
        y.append(d / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _vectors(ok: DataFrame) -> DataFrame:
    """The vector of every document, written.  Its word length is measured
    from the median of its source, shrunk towards its language's."""
    length = ok.withColumn("bin", F.floor(F.log2(F.col("word_chars") / F.col("n_words")) * 64).cast("int"))
    middle = F.pow(F.lit(2.0), (F.col("bin") + 0.5) / 64)
    of_lang = _quantile_bin(length, ["lang"], F.col("bin"), 0.5).select("lang", middle.alias("lang_mid"))
    of_source = _quantile_bin(length, ["lang", "source"], F.col("bin"), 0.5).select("lang", "source", middle.alias("own_mid"))
    sizes = ok.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("size"))
    own = F.col("size") / (F.col("size") + SHRINK)
    mids = write_table(
        of_source.join(of_lang, "lang").join(sizes, ["lang", "source"])
        .select("lang", "source", (own * F.col("own_mid") + (1 - own) * F.col("lang_mid")).alias("mid")), "quality-medians")
    n = F.col("n_words").cast("double")
    return write_table(
        ok.join(mids, ["lang", "source"]).select(
            "__row", "lang", "source",
            ((F.col("word_chars") - F.col("mid") * n) / F.sqrt(n)).alias("x1"),
            F.log1p(F.lit(20.0) * F.col("n_symbols") / n).alias("x2"),
            F.log1p(F.col("n_dup_lines").cast("double")).alias("x3"),
            (F.col("n_repeat_words") / n).alias("x4")),
        "quality-vectors")


def _half() -> Column:
    return F.pmod(F.xxhash64("__row"), F.lit(2)) == 0


def _starts(rows: DataFrame) -> DataFrame:
    """First estimates per ``grp`` and ``start``: coordinate-wise medians
    with median absolute deviations; moments of all rows; of half of them
    by hash (a group that has none there lacks this start)."""
    middle = None
    for x, m in zip(X, CENTRE):
        mid = _quantile_bin(rows, ["grp"], _signed_bin(F.col(x)), 0.5).select("grp", _bin_value(F.col("bin")).alias(m))
        middle = mid if middle is None else middle.join(mid, "grp")
    middle = write_table(middle, "quality-start")
    median = middle
    for i, (x, m) in enumerate(zip(X, CENTRE)):
        dev = _quantile_bin(rows.join(middle, "grp"), ["grp"], _signed_bin(F.abs(F.col(x) - F.col(m))), 0.5)
        median = median.join(dev.select("grp", F.pow(1.4826 * _bin_value(F.col("bin")), 2).alias(f"c{i}{i}")), "grp")
    for i, j in PAIRS:
        if i != j:
            median = median.withColumn(f"c{i}{j}", F.lit(0.0))
    everything = write_table(_moments(rows, ["grp"]), "quality-start")
    half = _moments(rows.where(_half()), ["grp"])
    columns = ["grp", *CENTRE, *COV]
    starts = median.select(F.lit("median").alias("start"), *columns)
    for name, estimate in (("all", everything), ("half", half)):
        starts = starts.unionByName(estimate.select(F.lit(name).alias("start"), *columns))
    return write_table(_with_floors(starts), "quality-estimate")


def robust_estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """``rows``: ``__row, grp, x1..``.  Per ``grp`` the count ``n``, centre
    and covariance (floors included) of the estimate, written."""
    by = ["grp", "start"]
    estimate = _starts(rows)
    for _ in range(steps):
        before = _factored(estimate)
        near = rows.join(before, "grp").withColumn("d2", _distance())
        limit = write_table(
            _quantile_bin(near, by, _log_bin(F.col("d2")), H_SHARE).withColumnRenamed("bin", "most"), "quality-limit")
        inner = near.join(limit, by).where(_log_bin(F.col("d2")) <= F.col("most"))
        after = write_table(_with_floors(_moments(inner, by)), "quality-estimate")
        fallen = _factored(after).join(before.select(*by, F.col("det").alias("was")), by).where(F.col("det") < F.col("was") - 1e-6)
        estimate = after
        if fallen.isEmpty():
            break
    # The least determinant; of equal ones the first start.
    best = _factored(estimate).groupBy("grp").agg(F.min(F.struct(
        F.round("det", 9).alias("det"), *[(F.col("start") != s).alias(f"not_{s}") for s in STARTS], "start")).alias("b"))
    chosen = estimate.join(best.select("grp", F.col("b.start").alias("start")), by).drop("start")
    wide = chosen.withColumns({
        f"c{i}{j}": CONSISTENCY * (F.col(f"c{i}{j}") - F.lit(FLOOR[i] ** 2 if i == j else 0.0))
        + F.lit(FLOOR[i] ** 2 if i == j else 0.0) for i, j in PAIRS})
    within = rows.join(_factored(wide), "grp").where(_distance() <= REWEIGHT)
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return write_table(
        _with_floors(_moments(within, ["grp"])).drop("n").join(sizes, "grp"), "quality-estimate")


def _level(tag: str, *keys: str) -> Column:
    """Name of a group: the level and its keys, told apart by length."""
    parts = [F.concat(F.length(k).cast("string"), F.lit(":"), F.col(k)) for k in keys]
    return F.concat(F.lit(tag), *parts)


def _shrunk(own: str, above: str, n: str, more: list[Column] | None = None) -> list[Column]:
    """Centre and covariance of ``own`` shrunk towards ``above`` by the
    count ``n``; ``more`` is added to the variances with the weight of
    ``above``."""
    out = []
    for c in CENTRE + COV:
        w = F.col(n) / (F.col(n) + (SHRINK if c in CENTRE else SHRINK_COV))
        value = w * F.col(f"{own}{c}") + (1 - w) * F.col(f"{above}{c}")
        if more is not None and c in (f"c{i}{i}" for i in range(DIMS)):
            value = value + (1 - w) * more[int(c[1])]
        out.append(value)
    return out


def outlier_distances(ok: DataFrame, steps: int = STEPS) -> DataFrame:
    """``__row, d2`` of documents that pass the base limits (a written table
    with ``lang``, ``source`` and the base statistics)."""
    vector = _vectors(ok)
    levels = F.array(F.lit("G"), _level("L", "lang"), _level("S", "lang", "source"))
    found = robust_estimates(vector.select("__row", *X, F.explode(levels).alias("grp")), steps)

    def at(prefix: str) -> DataFrame:
        return found.select(*[F.col(c).alias(f"{prefix}{c}") for c in ("grp", "n", *CENTRE, *COV)])

    keys = vector.select("lang", "source").distinct().withColumns(
        {"G_grp": F.lit("G"), "L_grp": _level("L", "lang"), "S_grp": _level("S", "lang", "source")})
    joined = keys
    for prefix in ("G_", "L_", "S_"):
        joined = joined.join(at(prefix), f"{prefix}grp")
    joined = write_table(joined, "quality-levels")
    # The spread between languages, each with the weight of its own estimate.
    w = F.col("L_n") / (F.col("L_n") + SHRINK)
    between = joined.dropDuplicates(["lang"]).groupBy("G_grp").agg(*[
        (F.sum(w * F.pow(F.col(f"L_{m}") - F.col(f"G_{m}"), 2)) / F.sum(w)).alias(f"b{i}") for i, m in enumerate(CENTRE)])
    names = CENTRE + COV
    of_lang = _shrunk("L_", "G_", "L_n", [F.col(f"b{i}") for i in range(DIMS)])
    joined = joined.join(between, "G_grp").withColumns({f"T_{c}": v for c, v in zip(names, of_lang)})
    final = joined.select("lang", "source", *[v.alias(c) for c, v in zip(names, _shrunk("S_", "T_", "S_n"))])
    final = write_table(_factored(final), "quality-final")
    return vector.join(final, ["lang", "source"]).select("__row", _distance().alias("d2"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", source_col: str = "source", steps: int = STEPS) -> DataFrame:
    """One row per document: ``doc_id``, the base statistics,
    ``base_failed``, ``distance`` (null when base_failed) and ``kept``."""
    named = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), _text_key(F.col(f"`{lang_col}`")).alias("lang"),
        _text_key(F.col(f"`{source_col}`")).alias("source"), F.col(f"`{text_col}`").alias("__text"))
    base = write_table(
        base_statistics(named, ["doc_id", "lang", "source"], "__text")
        .withColumn("__row", F.monotonically_increasing_id()), "quality-base")
    far = outlier_distances(base.where(~F.col("base_failed")), steps)
    return base.join(far, "__row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("d2").alias("distance"),
        (~F.col("base_failed") & (F.col("d2") <= CUTOFF)).alias("kept"))
