"""Scores of documents by prediction by partial matching over bytes.

The trie holds every training byte with the five bytes before it. The longest contexts count occurrences; a shorter
one counts in how many longer contexts a successor was seen (update exclusion). Escapes take a share d of every
successor: in a context of total n with q different successors, one counted c has (c - d) / n and the escape has
d q / n. After an escape the successors of the longer context are excluded from the shorter one. Below order 0 the bytes never seen are equally
likely. A text starts after line feeds and ends with the byte FF, which no UTF-8 text contains, so scores are those of
whole texts.

The trie is dealt to parts by the two last bytes of a context, so that a part holds all orders above 1 of its
contexts; orders 0 and 1 are one table of at most 65,536 counts. Blocks of documents ask the parts for the byte
sequences they hold, once each; hot parts are asked through salts. Word counts for the base score travel the same way.

Null texts count as empty; an empty text has one token, its end. Without any training document the trie predicts
all bytes alike and the base score is 0. Rows with a null id count by the text 'null'. One row per input row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintil.llm import blocks as B
from quintil.llm.text import remainder, word_hashes
from quintil.session import settle

ORDER = 5
END = b"\xff"
START = b"\n" * ORDER
CHUNK = 2 << 20  # bytes whose sequences are held at once
DISCOUNT = 0.4
SALT_BLOCKS = 512  # blocks that ask through one salt
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
U = np.uint64


def sequences(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, byte with the ORDER bytes before it) in chunks, whatever the length of a text."""
    held, owners, size = [], [], 0
    for number, text in enumerate(texts):
        data = START + text.encode() + END
        for at in range(0, len(data) - ORDER, CHUNK):
            piece = data[at : at + CHUNK + ORDER]
            held.append(piece)
            owners.append(number)
            size += len(piece)
            if size >= CHUNK:
                yield _keys(held, owners)
                held, owners, size = [], [], 0
    if held:
        yield _keys(held, owners)


def _keys(pieces: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array([len(p) for p in pieces])
    n = len(data) - ORDER
    keys = np.zeros(n, U)
    for i in range(ORDER + 1):
        keys = (keys << U(8)) | data[i : i + n]
    ends = np.cumsum(lengths)
    right = np.ones(len(data), bool)
    right[(ends - lengths)[:, None] + np.arange(ORDER)] = False  # the first bytes of a piece are context only
    return np.repeat(owners, lengths - ORDER), keys[right[ORDER:]]


def counted(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, their counts)."""
    joined = np.concatenate(keys) if keys else np.empty(0, U)
    if counts is None:
        joined = np.sort(joined)
        first = np.flatnonzero(np.r_[True, joined[1:] != joined[:-1]]) if len(joined) else np.empty(0, np.int64)
        return joined[first], np.diff(np.r_[first, len(joined)]).astype(np.int64)
    weights = np.concatenate(counts) if counts else np.empty(0, np.int64)
    order = np.argsort(joined, kind="stable")
    joined, weights = joined[order], weights[order]
    if not len(joined):
        return joined, weights
    first = np.flatnonzero(np.r_[True, joined[1:] != joined[:-1]])
    return joined[first], np.add.reduceat(weights, first)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, number of each key among them)."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]][: len(keys)]
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(first, dtype=np.int32) - 1
    return ordered[first], number


def distinct_sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = [counted([keys]) for _, keys in sequences(texts)]
    return counted([k for k, _ in found], [c for _, c in found])


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row in a sorted table or 0, whether it is there)."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Trie:
    """Contexts of orders 2 to ORDER of one part, over the shared table of pairs."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> None:
        self.pairs = pairs.reshape(256, 256)
        self.singles = (self.pairs > 0).sum(axis=0)
        self.levels: dict[int, dict[str, np.ndarray]] = {}
        for order in range(ORDER, 1, -1):
            if order < ORDER:
                keys, counts = counted([keys & U((1 << 8 * (order + 1)) - 1)])
            contexts = keys >> U(8)
            first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(keys) else np.empty(0, np.int64)
            sums = np.add.reduceat(counts, first) if len(first) else np.empty(0, np.int64)
            kinds = np.diff(np.r_[first, len(keys)])
            self.levels[order] = {"keys": keys, "counts": counts, "contexts": contexts[first], "n": sums, "q": kinds, "first": first}
        for order in range(2, ORDER + 1):  # what the successors of a context weigh in the next shorter one
            level = self.levels[order]
            weights = self._count(order - 1, level["keys"])
            level["excluded"] = np.add.reduceat(weights, level["first"]) if len(weights) else np.empty(0, np.int64)
        self.single_excluded = (self.pairs > 0) @ self.singles

    def _count(self, order: int, keys: np.ndarray) -> np.ndarray:
        if order == 0:
            return self.singles[(keys & U(0xFF)).astype(np.int64)]
        if order == 1:
            return self.pairs.ravel()[(keys & U(0xFFFF)).astype(np.int64)]
        at, there = find(self.levels[order]["keys"], keys & U((1 << 8 * (order + 1)) - 1))
        return np.where(there, self.levels[order]["counts"][at], 0) if len(self.levels[order]["keys"]) else np.zeros(len(keys), np.int64)

    def _context(self, order: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, q, weight of its successors in the next shorter context) of each key's context; zeros where unseen."""
        if order == 0:
            size = len(keys)
            return np.full(size, self.singles.sum()), np.full(size, (self.singles > 0).sum()), np.zeros(size, np.int64)
        if order == 1:
            last = ((keys >> U(8)) & U(0xFF)).astype(np.int64)
            return self.pairs.sum(axis=1)[last], (self.pairs > 0).sum(axis=1)[last], self.single_excluded[last]
        level = self.levels[order]
        if not len(level["contexts"]):
            none = np.zeros(len(keys), np.int64)
            return none, none, none
        at, there = find(level["contexts"], (keys & U((1 << 8 * (order + 1)) - 1)) >> U(8))
        return tuple(np.where(there, level[name][at], 0) for name in ("n", "q", "excluded"))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each key's last byte after its context."""
        out = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        taken_n, taken_q = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for order in range(ORDER, -1, -1):
            own = keys[open_]
            n, q, excluded = self._context(order, own)
            left_n, left_q = n - taken_n, q - taken_q
            count = self._count(order, own)
            seen = count > 0
            out[open_[seen]] += np.log10((count[seen] - DISCOUNT) / left_n[seen])
            escape = ~seen & (left_n > 0)
            out[open_[escape]] += np.log10(DISCOUNT * left_q[escape] / left_n[escape])
            open_, taken_n, taken_q = open_[~seen], excluded[~seen], q[~seen]
        out[open_] -= np.log10(256 - taken_q)
        return out


def pack_sorted(keys: np.ndarray) -> bytes:
    return B.pack(np.diff(keys, prepend=U(0))) if len(keys) else b""


def unpack_sorted(packed: bytes | None) -> np.ndarray:
    return np.cumsum(B.unpack(packed, U), dtype=U)


def _split(kind: int, keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, rows): byte sequences by the two last bytes of the context, words by their hash. Parts of kind 1 follow those of kind 0."""
    spread = (((keys >> U(8)) & U(0xFFFF)) * U(0x9E3779B97F4A7C15)) if kind == 0 else keys
    for part, rows in enumerate(B.split_by(spread, parts)):
        if len(rows):
            yield kind * parts + part, rows


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", modulus: int = 10) -> DataFrame:
    """Base and trie scores of all documents; those whose id has remainder 0 are held out of the training."""
    source = docs.select(
        docs[key].cast("long").alias("doc_id"), docs[text].alias("text"), (remainder(docs[key], modulus) == 0).alias("held_out")
    )
    number = B.count_blocks(source, "text")
    parts, salts = max(16, number // 4), -(-number // SALT_BLOCKS)
    dealt = B.deal(source, ["doc_id", "text", "held_out"], "doc_id", "text", number)

    def count(block: int, table: pa.Table) -> Iterator[tuple]:
        training = table.filter(pa.compute.invert(table.column("held_out")))
        texts = [t or "" for t in training.column("text").to_pylist()]
        words = counted([word_hashes(texts, lower=True)[1]])
        for kind, (keys, counts) in enumerate((distinct_sequences(texts), words)):
            for part, rows in _split(kind, keys, parts):
                yield part, block % salts, pack_sorted(keys[rows]), B.pack(counts[rows])

    def add(table: pa.Table) -> list[tuple]:
        keys, counts = counted(
            [unpack_sorted(p) for p in table.column("keys").to_pylist()], [B.unpack(p, np.int64) for p in table.column("counts").to_pylist()]
        )
        return [(table.column("part")[0].as_py(), pack_sorted(keys), B.pack(counts))]

    rows = "part int, salt int, keys binary, counts binary"
    counts = B.by_block(dealt, count, rows)
    halved = counts.groupBy("part", "salt").applyInArrow(lambda t: B.table_of(add(t), ["part", "keys", "counts"], MODEL), MODEL)
    model = settle(halved.groupBy("part").applyInArrow(lambda t: B.table_of(add(t), ["part", "keys", "counts"], MODEL), MODEL))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of bytes with the number of their longer contexts; under -1 the number of distinct words, under -2 their sum."""
        for batch in batches:
            for part, keys, values in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "counts"))):
                found, weights = unpack_sorted(keys), B.unpack(values, np.int64)
                if part < parts:
                    names, weights = counted([counted([found & U(0xFFFFFF)])[0] & U(0xFFFF)])
                    names = names.astype(np.int64)
                else:
                    names, weights = np.array([-1, -2]), np.array([len(found), weights.sum()])
                yield pa.RecordBatch.from_pydict({"name": pa.array(names), "n": pa.array(weights)})

    totals = {r["name"]: r["n"] for r in model.mapInArrow(sums, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).collect()}
    ends = source.where("NOT held_out").count()
    train_tokens, kinds = totals.pop(-2, 0) + ends, totals.pop(-1, 0) + (ends > 0)
    pairs = np.zeros(1 << 16, np.int64)
    pairs[list(totals.keys())] = list(totals.values())

    def ask(block: int, table: pa.Table) -> Iterator[tuple]:
        for kind, keys in enumerate(_wanted(table)):
            for part, rows in _split(kind, keys, parts):
                yield part, block % salts, block, pack_sorted(keys[rows])

    def reply(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys, values = np.empty(0, U), np.empty(0, np.int64)
        if known.num_rows:
            keys, values = unpack_sorted(known.column("keys")[0].as_py()), B.unpack(known.column("counts")[0].as_py(), np.int64)
        out = []
        if asked.num_rows:
            part = asked.column("part")[0].as_py()
            trie = Trie(keys, values, pairs) if part < parts else None
            for block, wanted in zip(asked.column("block").to_pylist(), asked.column("keys").to_pylist()):
                wanted = unpack_sorted(wanted)
                if trie is not None:
                    answer = trie.log10(wanted)
                else:
                    at, there = find(keys, wanted)
                    answer = np.where(there, values[at], 0) if len(keys) else np.zeros(len(wanted), np.int64)
                out.append((block, part, *B.pack_values(answer)))
        return B.table_of(out, ["block", "part", "values", "codes"], ANSWER)

    asked = B.by_block(dealt, ask, "part int, salt int, block long, keys binary")
    spread = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    answers = asked.groupBy("part", "salt").cogroup(spread.groupBy("part", "salt")).applyInArrow(reply, ANSWER)

    def rate(table: pa.Table, answers: pa.Table) -> Iterator[tuple]:
        given = {p: (v, c) for p, v, c in zip(*(answers.column(n).to_pylist() for n in ("part", "values", "codes")))}
        texts = [t or "" for t in table.column("text").to_pylist()]
        chunks = list(sequences(texts))
        owners = np.concatenate([o for o, _ in chunks]) if chunks else np.empty(0, np.int64)
        keys, number = numbered(np.concatenate([k for _, k in chunks]) if chunks else np.empty(0, U))
        chances = np.zeros(len(keys))
        for part, rows in _split(0, keys, parts):
            chances[rows] = B.unpack_values(*given[part], np.float64)
        scores = np.bincount(owners, chances[number], len(texts))
        owners, hashes = word_hashes(texts, lower=True)
        words, number = numbered(hashes)
        known = np.zeros(len(words), np.int64)
        for part, rows in _split(1, words, parts):
            known[rows] = B.unpack_values(*given[part], np.int64)
        under = train_tokens + 0.1 * (kinds + 1)
        bases = np.bincount(owners, np.log10((known + 0.1) / under)[number], len(texts)) + np.log10((ends + 0.1) / under)
        tokens = np.bincount(owners, minlength=len(texts)) + 1
        seen = np.bincount(owners, known[number] > 0, len(texts)).astype(np.int64) + (ends > 0)
        ids, held = table.column("doc_id").to_pylist(), table.column("held_out").to_pylist()
        yield from zip(ids, held, tokens.tolist(), seen.tolist(), [train_tokens] * len(ids), bases.tolist(), scores.tolist())

    return B.with_answers(dealt, answers, rate, SCHEMA)


MODEL = "part int, keys binary, counts binary"
ANSWER = "block long, part int, values binary, codes binary"


def _wanted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct byte sequences and word hashes of a block, sorted."""
    texts = [t or "" for t in table.column("text").to_pylist()]
    return distinct_sequences(texts)[0], counted([word_hashes(texts, lower=True)[1]])[0]
