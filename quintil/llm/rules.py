"""Quality rules with robust multivariate outliers, on the JVM alone.

Each document gets counts (words, characters, symbols, repeated lines, words in repeated windows) and a vector of shares
made of them, square-rooted or logarithmic, and drawn towards the usual for short texts. For each language and source
the minimum-covariance-determinant estimate of these vectors is found by concentration steps: from medians and
quartiles, the ``SUBSET`` share of rows at the smallest Mahalanobis distances gives the next mean and covariance, until
the steps are done. A document further away than the chi-square quantile with tail ``TAIL`` is rejected. Variances have
a floor, as a statistic that is 0 nearly everywhere has none of its own.

Groups of fewer than ``LEAST_ROWS`` rows are judged together; if all of these are too few as well, they are kept.
Null texts count as empty; documents without 10 words fail the base rules. Null languages and sources are a value of
their own. One row per input row, repeated rows included.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quintil.llm.lines import WORD_SQL, bind
from quintil.llm.text import words_column
from quintil.session import settle

SUBSET = 0.75
STEPS = 5
TAIL = 1e-6
LEAST_ROWS = 50
SALT_ROWS = 2_000  # rows of a group that meet in one place when estimates are joined to them
FLOOR = 0.04  # least standard deviation of a component
WINDOW = 5
SYMBOLS = "#*$%&|<>"
SEPARATORS = " \t\n\x0b\x0c\r"


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _repeat_words(words: Column) -> Column:
    """Number of words inside windows of WINDOW words that occur at least twice."""
    places = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(places, lambda i: F.xxhash64(*[F.element_at(words, i + (k + 1)) for k in range(WINDOW)]))

    def repeated(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(rows: Column) -> Column:
            mark = F.transform(
                rows, lambda x, j: F.when((F.get(rows, j - 1)["h"] == x["h"]) | (F.get(rows, j + 1)["h"] == x["h"]), x["i"])
            )
            return F.array_sort(F.filter(mark, lambda i: i.isNotNull()))

        covered = lambda at: F.aggregate(
            F.transform(at, lambda i, j: F.least(F.coalesce(F.get(at, j + 1) - i, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bind(bind(ordered, starts), covered))

    return bind(windows, repeated)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents' other columns with the base counts and their verdict."""
    body = F.coalesce(docs[text], F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD_SQL))
    tokens = bind(words_column(docs[text]), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    line = bind(lines, lambda v: F.struct(F.size(v).alias("n"), (F.size(v) - F.size(F.array_distinct(v))).alias("d")))
    chars = F.length(body)
    found = docs.select(
        *[docs[c] for c in docs.columns if c != text],
        tokens.alias("__w"),
        line.alias("__l"),
        _without(body, SEPARATORS).cast("long").alias("word_chars"),
        (chars - _without(body, SYMBOLS)).cast("long").alias("n_symbols"),
        (chars - _without(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("__upper"),
        (chars - _without(body, "!?")).alias("__marks"),
    )
    n, r = F.col("__w.n").cast("long"), F.col("__w.r").cast("long")
    shares = F.struct(
        F.log((F.col("word_chars") + 120) / (n + 20)).alias("v0"),
        F.sqrt(F.col("n_symbols") / (n + 20)).alias("v1"),
        F.sqrt(F.col("__upper") / (F.col("word_chars") + 120)).alias("v2"),
        F.sqrt(F.col("__marks") / (n + 20)).alias("v3"),
        (r / (n + 20)).alias("v4"),
        (F.col("__l.d") / (F.col("__l.n") + 5)).alias("v5"),
    )
    return found.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != text],
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("__l.d").cast("long").alias("n_dup_lines"),
        r.alias("n_repeat_words"),
        ((n < 10) | (100 * r > 20 * n)).alias("base_failed"),
        shares.alias("__v"),
    )


P = 6


def _chi2_tail(x: float, freedom: int) -> float:
    """Upper tail of chi-square for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for k in range(1, freedom // 2):
        term *= half / k
        total += term
    return math.exp(-half) * total


def chi2_quantile(tail: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2_tail(middle, freedom) > tail else (low, middle)
    return high


def _distance(v: list[Column], mean: list[Column], lower: list[list[Column]]) -> Column:
    """Squared Mahalanobis distance by forward substitution with a lower Cholesky factor."""

    def step(i: int, solved: list[Column]) -> Column:
        if i == P:
            return sum((y * y for y in solved[1:]), solved[0] * solved[0])
        rest = v[i] - mean[i]
        for k in range(i):
            rest = rest - lower[i][k] * solved[k]
        return bind(rest / lower[i][i], lambda y: step(i + 1, [*solved, y]))

    return step(0, [])


def _factor(moments: DataFrame) -> DataFrame:
    """Means m0.. and Cholesky factor l00, l10, .. from columns m and c of each group, with the floor on variances."""
    out = moments
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (F.lit(FLOOR**2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR**2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select("g", "salts", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)])


def _spread(groups: DataFrame) -> DataFrame:
    """A row for each salt of a group, so that a large group's rows need not meet to get its estimates."""
    return groups.select("*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s")).drop("salts")


def _with_distance(rows: DataFrame, groups: DataFrame) -> DataFrame:
    lower = [[F.col(f"l{i}{j}") for j in range(i + 1)] for i in range(P)]
    joined = rows.join(_spread(groups), ["g", "s"], "left")
    away = _distance([F.col(f"v{i}") for i in range(P)], [F.col(f"m{i}") for i in range(P)], lower)
    return joined.select(*rows.columns, F.when(F.col("m0").isNotNull(), away).alias("d2"))


def concentrate(rows: DataFrame, subset: float = SUBSET, steps: int = STEPS) -> DataFrame:
    """Mean and Cholesky factor of each group ``g`` of vectors v0, v1, ...: the last of the concentration steps.

    A row's ``s`` is one of its group's ``salts``.
    """
    salts = F.max("salts").alias("salts")
    quartiles = rows.groupBy("g").agg(salts, *[F.percentile_approx(f"v{i}", [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i in range(P)])
    start = quartiles.select(
        "g",
        "salts",
        *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(P)],
        *[(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)],
    )
    cut = chi2_quantile(1 - subset, P)
    grow = subset / (1 - _chi2_tail(cut, P + 2))  # makes the covariance of the inner rows that of all, for normal rows
    groups = settle(_factor(start))
    for _ in range(steps):
        away = _with_distance(rows, groups)
        limit = away.groupBy("g").agg(salts, F.percentile_approx("d2", subset, 10_000).alias("limit"))
        inner = away.join(_spread(limit), ["g", "s"]).where("d2 <= limit")
        moments = inner.groupBy("g").agg(
            salts,
            *[F.avg(f"v{i}").alias(f"m{i}") for i in range(P)],
            *[(F.covar_pop(f"v{i}", f"v{j}") * grow).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)],
        )
        groups = settle(_factor(moments))
    return groups


def judge(docs: DataFrame, text: str = "text", language: str = "lang", source: str = "source", tail: float = TAIL) -> DataFrame:
    """The documents' other columns, their counts, ``base_failed``, ``distance`` and ``kept``."""
    found = settle(counts(docs, text))
    marked = found.withColumn("__g", F.xxhash64(F.struct(found[language], found[source])))
    usable, every = F.count_if(~F.col("base_failed")), F.count("*")
    sizes = settle(marked.groupBy("__g").agg(usable.alias("usable"), every.alias("every")))
    small = sizes.where(F.col("usable") < LEAST_ROWS).agg(F.sum("usable"), F.sum("every")).first()
    large = sizes.where(F.col("usable") >= LEAST_ROWS).select("__g", F.ceil(F.col("every") / SALT_ROWS).cast("int").alias("__salts"))
    known = marked.join(large, "__g", "left")
    vector = [F.col(f"__v.v{i}").alias(f"v{i}") for i in range(P)]
    whole = [F.col(f"`{c}`") for c, kind in found.dtypes if "map<" not in kind and "variant" not in kind]  # copies differ by their ids
    own = F.col("__salts").isNotNull()
    count = F.coalesce("__salts", F.lit(max(1, -(-(small[1] or 0) // SALT_ROWS))))
    rows = settle(
        known.select(
            *found.columns, F.when(own, F.col("__g")).otherwise(F.lit(0)).alias("g"), count.alias("salts"),
            F.pmod(F.xxhash64(*whole), count).cast("int").alias("s"), *vector,
        )
    )
    fit_on = rows.where("NOT base_failed").select("g", "s", "salts", *[f"v{i}" for i in range(P)])
    estimates = concentrate(fit_on if (small[0] or 0) >= LEAST_ROWS else fit_on.where("g <> 0"))
    judged = _with_distance(rows, estimates)
    verdict = ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_quantile(tail, P), F.lit(True))
    return judged.select(*[F.col(f"`{c}`") for c in found.columns if c != "__v"], F.sqrt("d2").alias("distance"), verdict.alias("kept"))
