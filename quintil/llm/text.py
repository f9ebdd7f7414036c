"""Helpers shared by the text operators: words, hashes and the session's shared folder."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the word contract: a word is a run of anything but space, \t, \n, \v, \f and \r.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES_SQL = r"[\x20\x09-\x0D]+"
_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def lower_ascii(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def words_of(text: str | None) -> list[str]:
    """Words of a text; a null text has none."""
    return WORD.findall(text or "")


def words_column(text: Column) -> Column:
    """The same words on the JVM: split at separators, without the empty ends; null text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES_SQL), lambda w: w != "")


def lower_ascii_column(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; ids that are null count as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % modulus


PIECE = 1 << 20  # bytes hashed at once
_ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of an odd number and of its inverse modulo 2^64."""
    numbers = np.random.default_rng(0).integers(0, 1 << 64, 256, np.uint64)
    return numbers, *(_powers(base, PIECE) for base in (_ODD, pow(_ODD, -1, 1 << 64)))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def word_hashes(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, 64-bit hash) of every word in order, without a Python object per word.

    The hash is that of a word's bytes as a polynomial modulo 2^64, taken from running sums and mixed.
    """
    owners, hashes, held, numbers, size = [], [], [], [], 0
    for number, text in enumerate(texts):
        data = text.encode()
        held.append(data)
        numbers.append(number)
        size += len(data) + 1
        if size >= PIECE:
            _hash_piece(held, numbers, lower, owners, hashes)
            held, numbers, size = [], [], 0
    if held:
        _hash_piece(held, numbers, lower, owners, hashes)
    if not hashes:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(owners), np.concatenate(hashes)


def _hash_piece(held: list[bytes], numbers: list[int], lower: bool, owners: list, hashes: list) -> None:
    data = np.frombuffer(b" ".join(held) + b" ", np.uint8)
    inside = (data != 32) & ((data < 9) | (data > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.r_[0, edges] if inside[0] else edges
    starts, ends = edges[::2], edges[1::2]
    if lower:
        data = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
    by_byte, powers, inverse = _tables()
    if len(data) > len(powers):  # a single text longer than a piece
        powers, inverse = (_powers(base, len(data)) for base in (_ODD, pow(_ODD, -1, 1 << 64)))
    sums = np.cumsum(by_byte[data] * powers[: len(data)], dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    value = (sums[ends - 1] - before) * inverse[starts] + (ends - starts).astype(np.uint64)
    value ^= value >> np.uint64(33)
    value *= np.uint64(0xFF51AFD7ED558CCD)
    value ^= value >> np.uint64(33)
    first = np.cumsum([0] + [len(h) + 1 for h in held])
    owners.append(np.array(numbers)[np.searchsorted(first, starts, side="right") - 1])
    hashes.append(value)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
