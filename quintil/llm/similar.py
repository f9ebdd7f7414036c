"""Near copies by exact Jaccard similarity of word shingles.

A document is the set of its shingles (``width`` words, A-Z in lower case; a shorter text is one shingle, a text without
words the empty set) as 64-bit hashes. Documents with equal sets are one vertex, so copies of any number count once. Two
vertices link when their sets have a Jaccard similarity of 4/5 or more, counted on the sets themselves.

The operator of fuzzy SimHash (``simhash``) comes first, on shingles of the same width: every document's set is compared
with that of the first document of its component of fingerprints, a comparison a document, and what is similar becomes one
component. Fingerprints alone would lose links: their distance at similarity 0.8 is about 10 of 64 bits by calculation
(not measured), too far for the split into blocks. So the links that they miss come from MinHash.

Those candidates share one of 28 bands of four MinHash values. A pair at similarity 0.8 shares no band with probability
(1 - 0.8^4)^28 = 4e-7, and less above it: this is the only place where a link can be lost.

Pairs of a band are not listed. One member of every band is compared with its members of other components and the
components are made, so a large group of near copies becomes one component in few comparisons.
What is left, links between components and groups alike below the bound, goes through an exact prefix filter: shingles are
ordered by how many of the open documents hold them, rarest first; two similar sets share a shingle among their first fifth
or so. The places of the first shared one, then the number of shared ones, bound what two sets can have in common. Only pairs
that pass both bounds are read in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quintil.llm import simhash
from quintil.llm.components import smallest_reachable
from quintil.llm.text import word_hashes
from quintil.session import counted, in_few_partitions, settle

WIDTH = 5
BANDS, ROWS = 28, 4
ROUNDS = 1  # with one comparison a member
SLICE = 1 << 20  # characters read at once
CHUNK = 1 << 15  # shingles hashed at once, so that they stay in the cache
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    owners, words = word_hashes([t or "" for t in texts], lower=True)
    ends = np.searchsorted(owners, np.arange(len(texts)), side="right")
    full = max(len(words) - width + 1, 0)
    rolled = np.full(full, width, np.uint64)
    for place in range(width):
        rolled = _mix(rolled * _ODD + words[place : place + full])
    sets, start = [], 0
    for end in ends.tolist():
        if end - start >= width:
            sets.append(np.unique(rolled[start : end - width + 1]))
        elif end > start:
            short = np.full(1, end - start, np.uint64)
            for place in range(start, end):
                short = _mix(short * _ODD + words[place : place + 1])
            sets.append(short)
        else:
            sets.append(np.empty(0, np.uint64))
        start = end
    return sets


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    numbers = np.random.default_rng(1).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
    return numbers[0], numbers[1] | np.uint64(1)


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """A row of band keys for each set; sets are not empty."""
    least = np.empty((BANDS * ROWS, len(sets)), np.uint64)
    masks, factors = _functions()
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= CHUNK):
            size += len(sets[last])
            last += 1
        values = np.concatenate(sets[first:last])
        starts = np.cumsum([0] + [len(s) for s in sets[first : last - 1]])
        hashed = np.empty_like(values)
        for number, (mask, factor) in enumerate(zip(masks, factors)):
            np.bitwise_xor(values, mask, out=hashed)
            np.multiply(hashed, factor, out=hashed)
            least[number, first:last] = np.minimum.reduceat(hashed, starts)
        first = last
    keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], len(sets), axis=1)
    for row in range(ROWS):
        keys = _mix(keys * _ODD + least[row::ROWS])
    return keys.T


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    """(place of the first, texts) of about ``SLICE`` characters; the text is the last column."""
    held, size, first = [], 0, 0
    for place, value in enumerate(batch.column(batch.num_columns - 1)):
        held.append(value.as_py())
        size += len(held[-1] or "")
        if size >= SLICE or place == batch.num_rows - 1:
            yield first, held
            held, size, first = [], 0, place + 1


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _sketches(rows: DataFrame, width: int) -> DataFrame:
    """(key, h, set_id, n, bands) of rows (key, h, text); ``set_id`` is a hash of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _slices(batch):
                sets = shingle_sets(texts, width)
                sizes = np.array([len(s) for s in sets], np.int64)
                sums = np.array([_mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                ids = _mix(sums * _ODD + sizes.astype(np.uint64)).view(np.int64)
                some = np.flatnonzero(sizes)
                found = dict(zip(some.tolist(), bands_of([sets[i] for i in some])))
                bands = [found.get(i, np.empty(0, np.uint64)) for i in range(len(sets))]
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(ids), pa.array(sizes), _lists(bands)], ["key", "h", "set_id", "n", "bands"]
                )

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, h long, set_id long, n long, bands array<long>")


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(set_id, shingles) of rows (set_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _slices(batch):
                ids = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, _lists(shingle_sets(texts, width))], ["set_id", "shingles"])

    return rows.mapInArrow(run, "set_id long, shingles array<long>")


def _similar(common: Column, left: Column, right: Column) -> Column:
    """Jaccard similarity of 4/5 or more, in whole numbers."""
    return 9 * common >= 4 * (left + right)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    left = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(_similar(common, F.size("x"), F.size("y"))).select("a", "b")


def _across(left: str, right: str) -> Column:
    """Members of different components whose sizes allow the similarity."""
    a, b = F.col(f"{left}.n"), F.col(f"{right}.n")
    return (F.col(f"{left}.root") != F.col(f"{right}.root")) & _similar(F.least(a, b), a, b)


def _ordered(left: str, right: str) -> list[Column]:
    a, b = F.col(f"{left}.set_id"), F.col(f"{right}.set_id")
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _open(members: DataFrame) -> DataFrame:
    """Members of bands that hold more than one component."""
    bands = members.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    left = settle(members.join(bands.select("band"), "band", "left_semi"))
    return in_few_partitions(left, counted(left))


def _prefix_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that exact prefix bounds leave, of all that can be similar."""
    vertices = members.select("set_id", "n", "root").distinct()
    tokens = settle(sets.join(vertices.select("set_id"), "set_id", "left_semi").select("set_id", F.explode("shingles").alias("token")))
    tokens = in_few_partitions(tokens, counted(tokens))
    counts = tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    # A shingle of one set alone is matched by none; it only takes a place before all others.
    shared = tokens.join(counts, "token").groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("order"))
    # Of n shingles a similar set has 4n/5 or more, so one of the first n - ceil(4n/5) + 1 is shared.
    taken = (F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1).cast("int")
    alone = (F.col("n") - F.size("order")).cast("int")
    held = shared.join(vertices, "set_id").withColumns({"taken": taken, "alone": alone}).where("taken > alone")
    prefix = held.withColumn("prefix", F.slice("order", F.lit(1), F.col("taken") - F.col("alone"))).drop("order")
    prefix = settle(prefix.withColumn("last", F.element_at("prefix", -1)).withColumn("prefix", F.col("prefix.token")))
    prefix = in_few_partitions(prefix, counted(prefix, F.sum(F.size("prefix"))))

    entries = prefix.select("set_id", "n", "root", "alone", F.posexplode("prefix").alias("place", "token")).withColumn("place", F.col("place") + F.col("alone"))
    a, b = entries.alias("a"), entries.alias("b")
    most = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    met = (F.col("a.token") == F.col("b.token")) & (F.col("a.set_id") < F.col("b.set_id")) & _across("a", "b")
    near = a.join(b, met & _similar(most, F.col("a.n"), F.col("b.n"))).select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b")).distinct()

    # What is shared up to the end of the prefix that ends first is in both; the rest is behind it.
    left, right = (prefix.select(F.col("set_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("n", "taken", "last", "prefix")]) for s in ("a", "b"))
    common = F.size(F.array_intersect("a_prefix", "b_prefix"))
    rest = F.when(F.col("a_last") <= F.col("b_last"), F.col("a_n") - F.col("a_taken")).otherwise(F.col("b_n") - F.col("b_taken"))
    return near.join(left, "a").join(right, "b").where(_similar(common + rest, F.col("a_n"), F.col("b_n"))).select("a", "b")


def fingerprint_pairs(docs: DataFrame, marked: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Pairs (a, b) of the sets of each document and of the first of its component of fingerprints."""
    found = simhash.near_duplicates(docs, text, key, width).select(F.col(key).alias("key"), F.col("component_id").alias("first"))
    firsts = marked.groupBy(F.col("key").alias("first")).agg(F.min("set_id").alias("a"))
    pairs = found.join(marked.select("key", F.col("set_id").alias("b")), "key").join(firsts, "first").where("a != b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    to = roots.select(F.col("u").alias("set_id"), F.col("v").alias("to"))
    return members.drop("root").join(to, "set_id", "left").withColumn("root", F.coalesce("to", "set_id")).drop("to")


def _link(members: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v): every vertex of ``members`` (band, set_id, n) that is not the smallest of its component, with that one.

    ``roots`` holds the components of the links already known, in the same form.
    """
    plain = members
    members = _rooted(plain, roots)
    for number in range(ROUNDS + 1):
        members = _open(members)
        if members.isEmpty():
            break
        if number == ROUNDS:
            wanted = _prefix_pairs(members, sets)
        else:
            chosen = F.min_by(F.struct("set_id", "n", "root"), F.xxhash64("set_id", F.lit(number))).alias("one")
            one = members.groupBy("band").agg(chosen).select("band", "one.*").alias("a")
            b = members.alias("b")
            wanted = one.join(b, (F.col("a.band") == F.col("b.band")) & _across("a", "b")).select(*_ordered("a", "b")).distinct()
        fresh = _verified(wanted, sets)
        # The components so far are stars, so all earlier links are in them.
        roots = smallest_reachable(roots.select(F.col("u").alias("a"), F.col("v").alias("b")).union(fresh))
        members = _rooted(plain, roots)
    return roots


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The smallest key of every component of near copies, in a column ``key``; keys are not null."""
    rows = docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("h"), docs[text].alias("text"))
    one = F.min(F.struct("key", "h")).alias("one")
    marked = settle(_sketches(rows, width))
    vertices = settle(marked.groupBy("set_id", "n").agg(one, F.first("bands").alias("bands")))
    banded = vertices.select(F.explode("bands").alias("band"), "set_id", "n")
    shared = banded.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")
    members = settle(banded.join(shared, "band", "left_semi"))
    members = in_few_partitions(members, counted(members))
    pairs = settle(fingerprint_pairs(docs, marked, key, text, width))
    pairs = in_few_partitions(pairs, counted(pairs))
    used = members.select("set_id").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = vertices.join(used, "set_id", "left_semi").select("set_id", "one.key", "one.h")
    texts = rows.join(wanted, ["key", "h"]).select("set_id", "text").dropDuplicates(["set_id"])
    sets = settle(_sets(texts, width))
    sets = in_few_partitions(sets, counted(sets, F.sum(F.size("shingles"))))
    found = _link(members, sets, smallest_reachable(_verified(pairs, sets)))
    least = vertices.select("set_id", F.col("one.key").alias("key"))
    roots = found.select(F.col("u").alias("set_id"), F.col("v").alias("to"))
    joined = least.join(roots, "set_id", "left").groupBy(F.coalesce("to", "set_id")).agg(F.min("key").alias("key"))
    return joined.select("key").distinct()
