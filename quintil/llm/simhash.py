"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits; two link when at most three bits differ. Pigeonhole, twice: of four 16-bit blocks one is
free of errors, and of the two halves of the other 48 bits one has at most one error. That half (its first 23 bits)
is decoded with the perfect Golay code [23, 12, 7]. A word at distance 3 from its codeword also gets the five
codewords at distance 4, the others get theirs alone; two words that differ in at most two bits then share a codeword.
So every link shares one of eight kinds of key: the number of the exact block and half, the block's 16 bits, and a
codeword's 12-bit index. Candidates are joined on the key and verified on all 64 bits.

Only distinct fingerprints take part, so copies of any number count once. The join verifies candidates itself: its
output is links, not pairs of a key, and adaptive execution splits keys that many fingerprints share.

Null and empty texts have fingerprint zero and are linked like any other. One row is returned per input row,
repeated rows included.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintil.llm.components import smallest_reachable
from quintil.llm.text import lower_ascii, words_of
from quintil.session import settle

SEED = 42
MAX_BITS = 3
BLOCKS = 4
CHUNK = 1 << 16  # shingles counted at once


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned fingerprint: a bit is set if it is set in over half of the shingles' hashes."""
    words = words_of(lower_ascii(text or ""))
    if not words:
        return 0
    data = " ".join(words).encode()
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(data)]
    spans = list(zip(starts, ends[width - 1 :])) or [(0, len(data))]
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(spans), CHUNK):
        raw = b"".join([digest(data[a:b], SEED) for a, b in spans[at : at + CHUNK]])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(spans)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3) -> DataFrame:
    """Columns of the key and ``bits``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], ["key", "bits"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, bits long")


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2^11 syndromes of the code: its error pattern of weight 3 or less, and its weight."""
    patterns = [0] + [sum(1 << i for i in c) for n in (1, 2, 3) for c in _choose(23, n)]
    errors = np.zeros(2048, np.int64)
    errors[_syndrome(np.array(patterns, np.int64))] = patterns
    return errors, np.bitwise_count(errors)


def _choose(n: int, k: int) -> Iterator[tuple[int, ...]]:
    from itertools import combinations

    return combinations(range(n), k)


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1."""
    rest = words.copy()
    for shift in range(11, -1, -1):
        rest ^= ((rest >> (shift + 11)) & 1) * (0b101011100011 << shift)
    return rest


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 12-bit index of a codeword) for the codewords near each 23-bit word.

    The nearest codeword always; for a word at distance 3 also those at distance 4, which are where a flip of any
    right bit leads.
    """
    errors, weights = golay()
    syndromes = _syndrome(words)
    rows, found = [np.arange(len(words))], [words ^ errors[syndromes]]
    edge = np.flatnonzero(weights[syndromes] == 3)
    for bit in range(23):
        flipped = words[edge] ^ (1 << bit)
        nearest = flipped ^ errors[_syndrome(flipped)]
        rows.append(edge)
        found.append(nearest)
    both = np.unique((np.concatenate(rows) << 12) | (np.concatenate(found) >> 11))
    return both >> 12, both & 0xFFF


def keys_of(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every key of unsigned fingerprints."""
    rows, keys = [], []
    for block in range(BLOCKS):
        exact = (bits >> np.uint64(16 * block)) & np.uint64(0xFFFF)
        low = bits & np.uint64((1 << 16 * block) - 1)
        rest = low | ((bits >> np.uint64(16)) & ~np.uint64((1 << 16 * block) - 1))  # the other 48 bits
        for half in range(2):
            word = ((rest >> np.uint64(24 * half)) & np.uint64(0x7FFFFF)).astype(np.int64)
            row, index = codewords(word)
            rows.append(row)
            keys.append(((2 * block + half) << 28) | (exact[row].astype(np.int64) << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def links(distinct: DataFrame) -> DataFrame:
    """Verified links (a, b) with a < b between distinct fingerprints of a column ``bits``; each link once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, keys = keys_of(bits.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(bits[rows])], ["key", "bits"])

    keyed = distinct.select("bits").mapInArrow(run, "key long, bits long")
    a, b = keyed.alias("a"), keyed.alias("b")
    near = F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) <= MAX_BITS
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.bits") < F.col("b.bits")) & near)
    return pairs.select(F.col("a.bits").alias("a"), F.col("b.bits").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3) -> DataFrame:
    """(key, fingerprint, component_id): the smallest key that links lead to, the row's own included.

    Rows with a null key keep a null key; a component of such rows alone has a null component.
    """
    marked = settle(fingerprints(docs, text, key, width))
    groups = settle(marked.groupBy("bits").agg(F.min("key").alias("least")))
    roots = smallest_reachable(links(groups)).select(F.col("u").alias("bits"), F.col("v").alias("root"))
    rooted = groups.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    lookup = rooted.select("bits", "root").join(component, "root").select("bits", "component_id")
    return marked.join(lookup, "bits").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )
