"""Deletion of repeated runs of lines, on the JVM alone.

Each document is a sequence of line ids (hashes of the lines that hold a word). Ranks of its suffixes are made by prefix
doubling: the rank of 2h lines is the hash of the ranks of the h lines here and of the h lines after them. Ranks come
from the lines alone, so they agree across documents without a global sort, and the suffixes that share a rank are a
longest-common-prefix interval of at least that depth. A suffix is looked at to the depth where its lines hold
``min_words`` words, forwards and, for the ends of runs, backwards; as every line has a word, ``min_words`` bounds the
number of doublings. These windows cover every maximal repeated run of ``min_words`` words or more, and nothing else.

A line is deleted if such a run with it also starts at an earlier place, in order of doc_id, then line. Lines without a
word stay. A null text stays null and an empty one empty. A null doc_id is later than any other. Rows equal in doc_id and
text are one document at one place, so they do not delete each other's lines; rows that share only the doc_id are
ordered by a hash of their text. Other columns are kept; names that begin with ``__`` are not allowed in the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quintil.session import settle

MIN_WORDS = 50
WORD_SQL = r"[^\x20\x09-\x0D]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _sequence(text: Column) -> Column:
    """Lines with a word: place among all lines, number of words, two hashes."""
    lines = F.transform(
        F.split(text, "\n", -1),
        lambda x, i: F.struct(
            i.alias("at"), F.regexp_count(x, F.lit(WORD_SQL)).alias("w"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), F.reverse(x)).alias("b")
        ),
    )
    return F.filter(lines, lambda s: s["w"] > 0)


def _doubled(ranks: Column, step: int) -> Column:
    """Ranks of twice as many lines; suffixes that are too short drop out at the end."""
    return F.zip_with(
        F.slice(ranks, 1, F.greatest(F.size(ranks) - step, F.lit(0))),
        F.slice(ranks, step + 1, F.greatest(F.size(ranks) - step, F.lit(0))),
        lambda x, y: F.struct(F.xxhash64(x["a"], y["a"]).alias("a"), F.xxhash64(x["b"], y["b"]).alias("b")),
    )


def _levels(sequence: Column, min_words: int) -> Column:
    """Ranks at depths 1, 2, 4, ... up to ``min_words`` lines, as an array of arrays."""
    first = F.transform(sequence, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b")))
    levels = F.array(first)
    step = 1
    while 2 * step <= min_words:
        levels = bind(levels, _with_next(step))
        step *= 2
    return levels


def _with_next(step: int) -> Callable[[Column], Column]:
    return lambda levels: F.concat(levels, F.array(_doubled(F.element_at(levels, -1), step)))


def _depth(counts: Column, min_words: int) -> Column:
    """Number of leading lines that reach ``min_words`` words; 0 if they do not."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
    add = F.aggregate(
        counts,
        start,
        lambda acc, w: F.when(acc["sum"] >= min_words, acc).otherwise(F.struct((acc["sum"] + w).alias("sum"), (acc["n"] + 1).alias("n"))),
    )
    return bind(add, lambda acc: F.when(acc["sum"] >= min_words, acc["n"]).otherwise(0))


def _packed(first: Column, n: Column) -> Column:
    """First line and number of lines in one number."""
    return F.shiftleft(first.cast("long"), 32) + n


def _windows(sequence: Column, min_words: int) -> Column:
    """The least windows from each line and to each line: first line, number of lines, rank of the whole."""

    def of(seq: Column) -> Column:
        return bind(F.transform(seq, lambda s: s["w"]), lambda w: bind(_levels(seq, min_words), lambda v: named(seq, w, v)))

    def named(seq: Column, w: Column, levels: Column) -> Column:
        size = F.size(w)
        places = F.transform(seq, lambda s, i: i)
        forward = F.transform(places, lambda i: _packed(i, _depth(F.slice(w, i + 1, min_words), min_words)))

        def before(i: Column) -> Column:
            first = F.greatest(i - (min_words - 1), F.lit(0))
            return bind(
                _depth(F.reverse(F.slice(w, first + 1, i + 1 - first)), min_words), lambda n: _packed(i + 1 - n, n)
            )

        # Distinct numbers are found by hashing, distinct structs by comparing all pairs.
        packed = F.array_distinct(F.concat(forward, F.transform(places, before)))
        both = F.transform(packed, lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("from"), x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("n")))
        level = lambda n: F.floor(F.log2(n)).cast("int")

        def rank(x: Column) -> Column:
            k = level(x["n"])
            return bind(
                F.element_at(levels, k + 1),
                lambda r: bind(
                    F.struct(
                        F.element_at(r, x["from"] + 1).alias("s"),
                        F.element_at(r, (x["from"] + x["n"] - F.pow(F.lit(2), k) + 1).cast("int")).alias("e"),
                    ),
                    lambda p: F.struct(
                        x["from"].alias("from"),
                        x["n"].alias("n"),
                        F.xxhash64(p["s"]["a"], p["e"]["a"], x["n"]).alias("a"),
                        F.xxhash64(p["s"]["b"], p["e"]["b"], x["n"]).alias("b"),
                    ),
                ),
            )

        return F.transform(F.filter(both, lambda x: x["n"] > 0), rank)

    return bind(sequence, of)


def repeated_windows(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(d, h, from, n): windows that also start at an earlier place; d and h name the row."""
    place = F.coalesce(docs[key].cast("long"), F.lit((1 << 63) - 1))
    rows = docs.where(docs[text].isNotNull()).select(place.alias("d"), F.xxhash64(docs[text]).alias("h"), docs[text].alias("t"))
    windows = rows.select("d", "h", F.explode(_windows(_sequence(F.col("t")), min_words)).alias("x")).select("d", "h", "x.*")
    windows = settle(windows)
    first = windows.groupBy("a", "b").agg(F.min(F.struct("d", "h", "from")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    later = windows.join(first.drop("copies"), ["a", "b"]).where(F.col("first") < F.struct("d", "h", "from"))
    return later.select("d", "h", "from", "n")


def remove_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their text cut, and the columns n_lines and n_removed (lines with a word)."""
    spans = repeated_windows(docs, key, text, min_words).groupBy("d", "h").agg(F.collect_set(F.struct("from", "n")).alias("__spans"))
    marked = docs.withColumns({"__d": F.coalesce(docs[key].cast("long"), F.lit((1 << 63) - 1)), "__h": F.xxhash64(docs[text])})
    joined = marked.join(spans.select(F.col("d").alias("__d"), F.col("h").alias("__h"), "__spans"), ["__d", "__h"], "left")
    gone = F.array_distinct(F.flatten(F.transform(F.col("__spans"), lambda s: F.sequence(s["from"], s["from"] + s["n"] - 1))))
    lines = F.split(F.col(f"`{text}`"), "\n", -1)

    def cut(seq: Column) -> Column:
        taken = F.transform(gone, lambda i: F.element_at(seq, i + 1))
        kept = bind(lines, lambda v: F.transform(F.array_except(F.sequence(F.lit(0), F.size(v) - 1), taken), lambda i: v[i]))
        return F.array_join(kept, "\n")

    worded = F.transform(
        F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.rlike(WORD_SQL).alias("w"))), lambda s: s["w"]), lambda s: s["i"]
    )
    text_column = F.col(f"`{text}`")
    whole = F.when(F.col("__spans").isNull(), text_column).otherwise(bind(worded, cut))
    removed = F.when(F.col("__spans").isNull(), F.lit(0)).otherwise(F.size(gone))
    counted = joined.withColumns({"n_lines": F.coalesce(F.size(worded), F.lit(0)), "n_removed": removed, "__cut": whole})
    kept = [counted["__cut"].alias(c) if c == text else counted[c] for c in docs.columns if c not in ("n_lines", "n_removed")]
    return counted.select(*kept, F.when(text_column.isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"))
