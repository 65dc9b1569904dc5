"""Quality rules: fixed limits, then robust multivariate outliers, with DataFrame functions only.

Each document's statistics become a vector (mean word length, log symbols a word, shares of
repeated lines, repeated words and shouted words). Per language and source the minimum covariance
determinant is sought from three starts (medians with deviations from them, mean with covariance,
medians with the covariance of signs): a concentration step takes the ``SUPPORT`` of rows with the
smallest Mahalanobis distances and estimates centre and covariance anew; steps go on until the
determinant falls no more, and of the starts' estimates the one of the smallest determinant stays. The
squared FLOORS are part of every covariance, so that determinants do not vanish where rows agree.
Estimates are drawn to the mean of all groups' with the weight of ``SHRINK`` rows, which is what
judges the smallest groups. A vector beyond ``CUT`` is an outlier. Steps read a narrow table; sums and
quantiles are merged from partial ones, so a hot group costs no more than others; the driver gets one
row of means and, after each step, whether any determinant still falls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import BLANK, cut, discard, text_of

FEATURES = ("mean_length", "symbols", "dup_lines", "repeats", "shouts")
#: Least standard deviations: clean rows agree exactly in some statistics.
FLOORS = (0.35, 0.05, 0.12, 0.15, 0.05)
SUPPORT, SHRINK = 0.75, 20
#: A log-determinant that falls by no more than this has converged.
SETTLED = 1e-6
#: Squared distance beyond which a row is rejected; 30 is the chi-square quantile 0.99998 of 5 degrees.
CUT, CHI_MEDIAN = 30.0, 4.351
WINDOW = 8
#: A table with a row per group is broadcast up to this many rows, and joined by shuffles beyond.
MOST_BROADCAST = 50_000
KEY = ("lang_", "source_")
_D = range(len(FEATURES))
_LOWER = [(i, j) for i in _D for j in range(i + 1)]


def with_statistics(docs: DataFrame) -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shouts.

    A window of eight words is known by a 64-bit hash built by doubling: of words, then of pairs of
    hashes 1, 2 and 4 apart. Only texts where two hashes agree are sorted.
    """
    text = text_of()
    out = docs.withColumn("words_", F.array_remove(F.split(text, BLANK), ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({"n_words": F.size("words_").cast("long"), "lines_": lines})
    out = out.withColumn("h_", F.when(F.col("n_words") > WINDOW, F.transform("words_", lambda w: F.xxhash64(w))))

    def doubled(column: str, by: int) -> Column:
        n = F.size(column) - by
        return F.zip_with(F.slice(column, 1, n), F.slice(column, by + 1, n), lambda a, b: F.xxhash64(a, b))

    for by in (1, 2, 4):
        out = out.withColumn("h_", doubled("h_", by))
    out = out.withColumn("s_", F.when(F.size(F.array_distinct("h_")) < F.size("h_"), F.sort_array(F.transform("h_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    n = F.size("s_") - 1
    twice = F.zip_with(F.slice("s_", 1, n), F.slice("s_", 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    out = out.withColumn("p_", F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull())))))
    n = F.size("p_") - 1
    steps = F.zip_with(F.slice("p_", 1, n), F.slice("p_", 2, n), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    repeats = F.when(F.col("p_").isNotNull(), F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x)).otherwise(0)
    return out.withColumns({
        "word_chars": F.length(F.array_join("words_", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
        "n_repeat_words": repeats.cast("long"),
        "n_lines": F.size("lines_").cast("long"),
        "n_shouts": F.regexp_count(text, F.lit("[A-Z]{3,}")).cast("long"),
    }).drop("words_", "lines_", "h_", "s_", "p_")


BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def _vector() -> Column:
    each = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return F.array(F.col("word_chars") / each, F.log1p(F.col("n_symbols") / each), F.col("n_dup_lines") / lines, F.col("n_repeat_words") / each, F.col("n_shouts") / each)


def _distance(mu: str = "mu", inv: str = "inv") -> Column:
    """Squared length of inv * (x - mu); inv is the inverse of the covariance's Cholesky factor."""
    rows = ([f"{inv}[{at}] * (x_[{j}] - {mu}[{j}])" for at, (k, j) in enumerate(_LOWER) if k == i] for i in _D)
    return F.expr(" + ".join(f"pow({' + '.join(row)}, 2)" for row in rows))


def _factored(params: DataFrame) -> DataFrame:
    """Adds to (.., mu, cov) inv, the rows of the inverse of the Cholesky factor of cov, and logdet.

    cov lists the lower triangle by rows; the squared floors are added here.
    """
    at = lambda i, j: _LOWER.index((max(i, j), min(i, j)))
    rows = ", ".join(f"array({', '.join([f'cov[{at(i, j)}]' + (f' + {FLOORS[i] ** 2!r}D' if i == j else '') for j in _D] + ['1D' if i == j else '0D' for j in _D])})" for i in _D)
    floors = f"array({', '.join(f'{x ** 2!r}D' for x in FLOORS)})"
    # symmetric elimination of (cov | 1): one short expression, as a chain of columns costs the driver most of a step
    pivot = f"transform(m[k], x -> x / sqrt(greatest(m[k][k], {floors}[k])))"
    below = f"transform(m, (r, i) -> CASE WHEN i < k THEN r WHEN i = k THEN {pivot} ELSE zip_with(r, {pivot}, (x, y) -> x - {pivot}[i] * y) END)"
    done = params.selectExpr("*", f"aggregate(sequence(0, {len(_D) - 1}), array({rows}), (m, k) -> {below}) AS m_")
    inverse = f"array({', '.join(f'm_[{i}][{len(_D) + j}]' for i, j in _LOWER)}) AS inv"
    return done.selectExpr(*params.columns, inverse, " + ".join(f"-2 * ln(m_[{i}][{len(_D) + i}])" for i in _D) + " AS logdet")


def _estimated(rows: DataFrame, *by: str) -> DataFrame:
    """Mean and covariance of x_ for each group."""
    mu, cov = ", ".join(f"avg(x_[{i}])" for i in _D), ", ".join(f"covar_pop(x_[{i}], x_[{j}])" for i, j in _LOWER)
    return rows.groupBy(*by).agg(F.expr(f"array({mu})").alias("mu"), F.expr(f"array({cov})").alias("cov"))


def _starts(rows: DataFrame, small) -> DataFrame:
    """(group, start, mu, cov): three rows a group."""
    x, m = lambda i: F.col("x_")[i], lambda i: F.col("mu")[i]
    median = rows.groupBy(*KEY).agg(F.array(*(F.percentile_approx(x(i), 0.5) for i in _D)).alias("mu"))
    off = rows.join(small(median), [*KEY])
    mad = off.groupBy(*KEY).agg(F.first("mu").alias("mu"), F.array(*(F.percentile_approx(F.abs(x(i) - m(i)), 0.5) for i in _D)).alias("mad"))
    mad = cut(mad, "mcd")
    wide = lambda i: F.greatest(F.col("mad")[i] * 1.4826, F.lit(FLOORS[i]))
    first = mad.select(*KEY, F.lit(0).alias("start"), "mu", F.array(*(wide(i) * wide(i) if i == j else F.lit(0.0) for i, j in _LOWER)).alias("cov"))
    second = _estimated(rows, *KEY).select(*KEY, F.lit(1).alias("start"), "mu", "cov")
    z = F.array(*((x(i) - m(i)) / wide(i) for i in _D))
    norm = F.greatest(F.aggregate("z", F.lit(0.0), lambda s, y: s + y * y), F.lit(1e-12))
    signs = rows.join(small(mad), [*KEY]).withColumn("z", z).withColumn("norm", norm)
    third = signs.groupBy(*KEY).agg(F.first("mu").alias("mu"), F.array(*(len(_D) * F.avg(F.col("z")[i] * F.col("z")[j] * wide(i) * wide(j) / F.col("norm")) for i, j in _LOWER)).alias("cov"))
    return first.union(second).union(third.select(*KEY, F.lit(2).alias("start"), "mu", "cov"))


def concentrated(rows: DataFrame, params: DataFrame, small) -> DataFrame:
    """One step for each (group, start)."""
    by = [*KEY, "start"]
    near = rows.join(small(params.select(*by, "mu", "inv")), [*KEY]).select(*by, "x_", _distance().alias("d2"))
    limit = near.groupBy(*by).agg(F.percentile_approx("d2", SUPPORT).alias("limit"))
    return _factored(_estimated(near.join(small(limit), by).where("d2 <= limit"), *by))


def fit(stats: DataFrame) -> DataFrame:
    """Centre, inverse factor and scale for each group, from the rows that pass the limits."""
    rows = stats.where(f"NOT ({BASE_FAILED})").select(*_key(), _vector().alias("x_"))
    counts = cut(rows.groupBy(*KEY).agg(F.count("*").alias("n")), "mcd")
    small = F.broadcast if counts.count() <= MOST_BROADCAST else lambda table: table
    active, found = cut(_factored(_starts(rows, small)), "mcd"), []
    while not active.isEmpty():
        last = active.select(*KEY, "start", F.col("logdet").alias("last"))
        told = cut(concentrated(rows, active, small).join(last, [*KEY, "start"]), "mcd")
        # a start's own determinant is not that of so many rows, so the first step always counts
        moved = F.col("logdet") < F.col("last") - SETTLED if found else F.lit(True)
        found.append(told.where(~moved))
        active = told.where(moved)
    best = reduce(DataFrame.union, found or [active.withColumn("last", F.col("logdet"))])
    best = best.groupBy(*KEY).agg(F.min_by(F.struct("mu", "cov"), F.struct("logdet", "start")).alias("e")).join(counts, [*KEY])
    best = cut(best.select(*KEY, "n", "e.mu", "e.cov"), "mcd")
    mean = lambda c, k: F.sum(F.col(c)[k] * F.col("n")) / F.sum("n")
    pooled = best.agg(F.array(*(mean("mu", k) for k in _D)), F.array(*(mean("cov", k) for k in range(len(_LOWER))))).first()
    drawn = lambda c, to, k: (F.col(c)[k] * F.col("n") + to[k] * SHRINK) / (F.col("n") + SHRINK) if to[k] is not None else F.col(c)[k]
    params = _factored(best.select(*KEY, F.array(*(drawn("mu", pooled[0], k) for k in _D)).alias("mu"), F.array(*(drawn("cov", pooled[1], k) for k in range(len(_LOWER)))).alias("cov")))
    params = cut(params.select(*KEY, "mu", "inv"), "mcd")
    scale = rows.join(small(params), [*KEY]).groupBy(*KEY).agg(F.greatest(F.percentile_approx(_distance(), 0.5) / CHI_MEDIAN, F.lit(1.0)).alias("scale"))
    return cut(params.join(scale, [*KEY]), "mcd")


def _key() -> list[Column]:
    """A group's language and source; null is a value that no text has."""
    return [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(k) for c, k in zip(("lang", "source"), KEY)]


def judge(stats: DataFrame, params: DataFrame) -> DataFrame:
    """The rows with base_failed and kept; a group of which no row passes the limits has no estimate, and keeps none."""
    names = stats.columns
    rows = stats.select("*", *_key(), _vector().alias("x_"), F.expr(BASE_FAILED).alias("base_failed"))
    rows = rows.join(params, [*KEY], "left")
    verdict = F.coalesce(_distance() / F.col("scale") <= CUT, F.lit(True))
    return rows.withColumn("kept", ~F.col("base_failed") & verdict).select(*names, "base_failed", "kept")


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_shouts")


def rate_quality(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of every row.

    A null or empty text has no words and so fails the limits; a null lang or source is a value of
    its own, apart from an empty one; repeated rows and ties in distance are judged alike; a group of
    few rows is judged mostly by the mean of all groups' estimates; an empty table gives no rows.
    Further columns are left out.
    """
    stats = cut(with_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality")
    return judge(stats, fit(stats)).select("doc_id", *COLUMNS, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with their columns.

    Statistics are made again where the rows are read for good, as texts beside them would be a second
    copy of the input on disk that stays until the result is written.
    """
    names = docs.columns
    held = docs.select(*(F.col(c).alias(c if c in ("text", "lang", "source") else f"in_{c}") for c in names))
    stats = cut(with_statistics(held.select("text", "lang", "source")).drop("text"), "quality")
    # generated, so that the verdict's filter is not pushed below: it would hold each statistic's formula again and again
    again = with_statistics(held).select(*held.columns, F.inline(F.array(F.struct(*COLUMNS, *EXTRA))))
    good = judge(again, fit(stats)).where("kept")
    discard(stats)
    return good.select(*held.columns).toDF(*names)
