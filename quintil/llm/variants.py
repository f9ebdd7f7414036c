"""Spelling variants of a vocabulary by pivotal grams.

Bigrams are ordered by how many words hold them, rarest first. The prefix of a word is its first three in that order,
with all that tie with the third; two disjoint ones of least total frequency, found by dynamic programming, are its
pivots. One edit spoils at most one of two disjoint bigrams, so of two words one edit apart, a pivot of the word whose
prefix ends earlier is in the other's prefix, at a place that differs by one at most.

Frequent bigrams make long lists, so pivots are matched with their context: a word is cut in three, the edit lies in one
of the parts, and the letters outside that part are in both words. A list holds the words with a bigram in their prefix
and those letters at their two ends; pivots look up their own lists, once for each part. A bounded edit distance then
verifies each pair, and adaptive execution splits lists that are long. No list is cut.

A word's form is its near word of largest count (ties: the smallest in code-point order) if that count is ``ratio`` times
its own or more. Forms are followed to the last by doubling the reach, in a number of rounds that the counts bound.
Null words and null counts are ignored, repeated words are added up.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quintil.llm.text import lower_ascii_column
from quintil.session import settle

# Fixed values of the contract: letters of a run.
RUN_SQL = r"[A-Za-zÀ-ÿ]+"
GRAM, PIVOTS = 2, 2
PREFIX = GRAM * (PIVOTS - 1) + 1
PARTS = 3
SHORTEST = PREFIX + GRAM - 1
ENTRY = "k long, word string, n long, first int, last int"


def runs_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, run): every run of letters of every text, A-Z in lower case."""
    found = F.explode(F.regexp_extract_all(docs[text], F.lit(RUN_SQL), F.lit(0)))
    return docs.select(docs[key].alias("doc_id"), found.alias("run")).withColumn("run", lower_ascii_column(F.col("run")))


def damaged(doc_id: Column, run: Column, modulus: int) -> Column:
    """The run without one letter where ``modulus`` divides the crc32 of ``doc_id:run``; a null id counts as ``null``."""
    h = F.crc32(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % modulus == 0, cut).otherwise(run)


def vocabulary(words: DataFrame, min_length: int, min_count: int) -> DataFrame:
    """(word, n) of the words in the column ``word``; counts combine before they travel."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def pivots(instances: list[tuple[int, int]], count: int = PIVOTS, width: int = GRAM) -> list[int]:
    """Positions of ``count`` disjoint grams of least total weight; ``instances`` are (position, weight) by position."""
    positions = [p for p, _ in instances]
    best: list[tuple[int, tuple[int, ...]] | None] = [(0, ())] * (len(instances) + 1)
    for _ in range(count):
        new: list[tuple[int, tuple[int, ...]] | None] = [None]
        for i, (place, weight) in enumerate(instances):
            before = best[bisect_right(positions, place - width)]
            taken = None if before is None else (before[0] + weight, (*before[1], place))
            new.append(min((x for x in (new[-1], taken) if x is not None), default=None))
        best = new
    return list(best[-1][1])


class Grams:
    """The order of bigrams, and what a word looks up and is listed under."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts

    def prefix(self, word: str) -> dict[str, list[int]]:
        """Positions of the bigrams of a word's prefix."""
        held: dict[str, list[int]] = {}
        for i in range(len(word) - 1):
            held.setdefault(word[i : i + GRAM], []).append(i)
        taken, prefix = 0, {}
        for gram in sorted(held, key=lambda g: (self.counts[g], g)):
            if taken >= PREFIX:
                break
            prefix[gram] = held[gram]
            taken += len(held[gram])
        return prefix

    def listed(self, word: str) -> Iterator[tuple[str, int, int]]:
        """(key, first and last place of the bigram) of every list that holds the word."""
        size = len(word)
        prefix = self.prefix(word)
        for length in range(size - 1, size + 2):
            for part, begin, end in parts(length):
                context = f"{length}\0{part}\0{word[:begin]}\0{word[size - length + end :]}"
                for gram, places in prefix.items():
                    yield f"{gram}{context}", places[0], places[-1]

    def looked_up(self, word: str) -> Iterator[tuple[str, int, int]]:
        """(key, first and last place at which the pivot may stand) of every list to look up."""
        size = len(word)
        instances = sorted((p, self.counts[g]) for g, places in self.prefix(word).items() for p in places)
        weights = dict(instances)
        chosen = sorted(pivots(instances), key=lambda p: (weights[p], p))
        for part, begin, end in parts(size):
            # A pivot that no edit of this part can touch is enough; else either may be the one left.
            safe = [p for p in chosen if p + 1 < begin or p >= end][:1]
            for place in safe or chosen:
                yield f"{word[place : place + GRAM]}{size}\0{part}\0{word[:begin]}\0{word[end:]}", place - 1, place + 1


def parts(length: int) -> list[tuple[int, int, int]]:
    """(number, begin, end) of the parts of a word that hold a letter."""
    cuts = [length * i // PARTS for i in range(PARTS + 1)]
    return [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]


def _entries(words: DataFrame, counts: dict[str, int], listed: bool) -> DataFrame:
    """The words under the hashes of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(counts)
        keys = grams.listed if listed else grams.looked_up
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                held = batch.slice(start, 1000).to_pydict()
                rows = [
                    (xxhash.xxh64_intdigest(k) - (1 << 63), w, n, first, last)
                    for w, n in zip(held["word"], held["n"])
                    for k, first, last in keys(w)
                ]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32())
                columns = zip(*rows) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["k", "word", "n", "first", "last"])

    return words.select("word", "n").mapInArrow(run, ENTRY)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every pair of words one edit apart, both ways round; ``words`` is a written table."""
    grams = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(GRAM)))))
    # As many rows as there are bigrams of the alphabet, whatever the size of the vocabulary.
    counts = {r.gram: r.c for r in words.select(grams.alias("gram")).groupBy("gram").agg(F.count("*").alias("c")).toLocalIterator()}
    a = _entries(words, counts, listed=False).alias("a")
    b = _entries(words, counts, listed=True).alias("b")
    within = (F.col("a.first") <= F.col("b.last")) & (F.col("b.first") <= F.col("a.last"))
    one_edit = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    met = a.join(b, (F.col("a.k") == F.col("b.k")) & within & (F.col("a.word") != F.col("b.word")) & one_edit)
    ordered = F.col("a.word") < F.col("b.word")
    pair = lambda c: [F.when(ordered, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")), F.when(ordered, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))]
    (u, v), (nu, nv) = pair("word"), pair("n")
    once = met.select(u.alias("word"), nu.alias("n"), v.alias("other"), nv.alias("other_n")).distinct()
    ways = F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return once.select(F.explode(ways).alias("w")).select("w.*")


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n); words have at least four code points."""
    if ratio < 2:
        raise ValueError("A form must be at least twice as frequent as its word.")
    plain = words.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    known = settle(plain)
    least, low, high = known.agg(F.min(F.length("word")), F.min("n"), F.max("n")).first()
    if least is not None and least < SHORTEST:
        raise ValueError(f"Two disjoint bigrams of a prefix need words of {SHORTEST} code points or more.")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("word"))).alias("best")
    near = near_words(known).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    usual = -F.col("best.minus") >= ratio * F.col("n")
    formed = near.select("word", F.when(usual, F.col("best.word")).alias("form"), F.when(usual, -F.col("best.minus")).alias("form_n"), "n_near")
    formed = settle(formed)

    reach = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # A step multiplies the count by ``ratio`` or more, which bounds the length of a chain.
    longest = 0
    while low and high >= max(low, 1) * ratio ** (longest + 1):
        longest += 1
    done = 1
    while done < longest:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reach = settle(reach.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        done *= 2
    return (
        known.join(formed, "word", "left")
        .join(reach, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )
