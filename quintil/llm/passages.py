"""Removal of passages that recur across documents, with sharded Aho-Corasick automata.

1. Anchors: of each window of consecutive words the smallest hash among its shorter n-grams. Equal windows have equal
   anchors, neighbouring windows mostly share theirs, so few hashes travel. Those found in two documents recur.
2. Windows over a recurring anchor are confirmed by a 96-bit digest; the smallest doc_id of each is gathered.
3. Each block of documents compiles the anchor phrases of the windows that it must look for into its own automaton
   (pyahocorasick) and streams all of its documents through it. Where a phrase occurs, the windows over it are compared
   with the recurring ones word by word. A phrase is shared by the windows around it, so the automaton stays small.

Texts without words, and null texts, keep nothing and lose nothing. A null doc_id counts as larger than any other and
equal ids never remove each other's words. One row per input row, repeated rows included.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintil.llm import blocks as B
from quintil.llm.text import word_hashes
from quintil.session import settle

WINDOW = 13
ANCHOR = 6  # words of an anchor's n-gram
NO_ID = np.iinfo(np.int64).max
SCHEMA = "doc_id long, n_words long, n_removed long, kept string, removed array<int>"


class Words:
    """A block's documents in order of their ids, with the hashes of all their words in one array."""

    def __init__(self, table: pa.Table) -> None:
        ids = table.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.doc_ids = [ids[i] for i in order]
        self.ids = np.array([NO_ID if i is None else i for i in self.doc_ids], np.int64)
        texts = table.column("text")
        self.texts = [texts[i].as_py() or "" for i in order]
        self.owner, self.hashes = word_hashes(self.texts)
        counts = np.bincount(self.owner, minlength=len(order))
        self.start = np.cumsum(counts) - counts

    def rolled(self, width: int, salt: int) -> np.ndarray:
        """Mixed hash of each run of ``width`` words, runs over the end of a document included."""
        n = max(0, len(self.hashes) - width + 1)
        out = np.zeros(n, np.uint64)
        for i in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15 + 2 * salt) + (self.hashes[i : i + n] ^ np.uint64(salt))
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(places of the windows, their anchors)."""
        n = len(self.hashes) - WINDOW + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        least = self.rolled(ANCHOR, 1)
        span, reach = 1, WINDOW - ANCHOR + 1
        while span < reach:
            step = min(span, reach - span)
            least = np.minimum(least[: len(least) - step], least[step:])
            span += step
        places = np.flatnonzero(self.owner[:n] == self.owner[WINDOW - 1 :])
        return places, least[places]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct anchors, whether two documents here hold them)."""
        places, anchors = self.windows()
        owner = self.owner[places]
        if len(anchors):
            new = np.r_[True, (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])]
            anchors, owner = anchors[new], owner[new]
        order = np.argsort(anchors, kind="stable")
        anchors, owner = anchors[order], owner[order]
        first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]]) if len(anchors) else np.empty(0, np.int64)
        last = np.r_[first[1:], len(anchors)] - 1 if len(first) else first
        return anchors[first], owner[first] != owner[last]

    def candidates(self, flags: dict[int, np.ndarray], parts: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, digests) of the windows over recurring anchors; a digest has 64 and 32 bits."""
        distinct, _ = self.anchors()
        recurring = [distinct[rows][flags[p].astype(bool)] for p, rows in enumerate(B.split_by(distinct, parts)) if p in flags]
        places, anchors = self.windows()
        known = np.sort(np.concatenate(recurring)) if recurring else np.empty(0, np.uint64)
        if not len(known) or not len(anchors):
            return places[:0], np.empty((0, 2), np.uint64)
        at = np.minimum(np.searchsorted(known, anchors), len(known) - 1)
        places = places[known[at] == anchors]
        return places, np.stack([self.rolled(WINDOW, 3)[places], self.rolled(WINDOW, 5)[places] & np.uint64(0xFFFFFFFF)], axis=1)


def _distinct(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct digests, first row of each, number of each row's digest); earlier rows have smaller doc_ids."""
    if not len(digests):
        return digests, np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    rows = digests[order]
    new = np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return rows[new], order[new], number


def _flags(answers: pa.Table, kind: int, dtype: type) -> dict[int, np.ndarray]:
    rows = zip(answers.column("kind").to_pylist(), answers.column("part").to_pylist(), answers.column("answer").to_pylist())
    return {part: B.unpack(answer, dtype) for k, part, answer in rows if k == kind}


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed): the words left, joined by a space, and the removed spans.

    A word goes if a window over it also starts in a document with a smaller id. ``removed`` lists first and past-last
    word numbers by turns.
    """
    source = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    number = B.count_blocks(source, "text")
    parts = max(16, number // 4)
    dealt = B.deal(source, ["doc_id", "text"], "doc_id", "text", number)

    def ask_anchors(block: int, table: pa.Table) -> Iterator[tuple]:
        anchors, shared = Words(table).anchors()
        for part, rows in enumerate(B.split_by(anchors, parts)):
            if len(rows):
                yield part, block, B.pack(anchors[rows]), B.pack(shared[rows].astype(np.uint8))

    def recurring(table: pa.Table) -> list[tuple]:
        asked = [B.unpack(p, np.uint64) for p in table.column("anchors").to_pylist()]
        shared = np.concatenate([B.unpack(p, np.uint8) for p in table.column("shared").to_pylist()])
        distinct, number, counts = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
        more = counts > 1
        more[number[shared > 0]] = True
        answers = np.split(more[number].astype(np.uint8), np.cumsum([len(a) for a in asked])[:-1])
        part = table.column("part")[0].as_py()
        return [(b, 1, part, B.pack(a)) for b, a in zip(table.column("block").to_pylist(), answers) if a.any()]

    answer = "block long, kind int, part int, answer binary"
    asked = B.by_block(dealt, ask_anchors, "part int, block long, anchors binary, shared binary")
    found = settle(B.exchange(asked, recurring, answer))

    def ask_windows(table: pa.Table, answers: pa.Table) -> Iterator[tuple]:
        if not answers.num_rows:
            return
        held = Words(table)
        places, digests = held.candidates(_flags(answers, 1, np.uint8), parts)
        distinct, first, _ = _distinct(digests)
        ids = held.ids[held.owner[places[first]]]
        block = answers.column("block")[0].as_py()
        for part, rows in enumerate(B.split_by(distinct[:, 0], parts)):
            if len(rows):
                yield part, block, B.pack(distinct[rows, 0]), B.pack(distinct[rows, 1].astype(np.uint32)), B.pack(ids[rows])

    def smallest(table: pa.Table) -> list[tuple]:
        halves = zip(table.column("high").to_pylist(), table.column("low").to_pylist())
        asked = [np.stack([B.unpack(h, np.uint64), B.unpack(w, np.uint32).astype(np.uint64)], axis=1) for h, w in halves]
        ids = np.concatenate([B.unpack(p, np.int64) for p in table.column("ids").to_pylist()])
        distinct, _, number = _distinct(np.concatenate(asked))
        least = np.full(len(distinct), NO_ID)
        np.minimum.at(least, number, ids)
        answers = np.split(least[number], np.cumsum([len(a) for a in asked])[:-1])
        part = table.column("part")[0].as_py()
        return [(b, 2, part, B.pack(a)) for b, a in zip(table.column("block").to_pylist(), answers)]

    windows = B.with_answers(dealt, found, ask_windows, "part int, block long, high binary, low binary, ids binary")
    confirmed = B.exchange(windows, smallest, answer)

    def locate(table: pa.Table, answers: pa.Table) -> Iterator[tuple]:
        held = Words(table)
        places, digests = held.candidates(_flags(answers, 1, np.uint8), parts)
        distinct, first, number = _distinct(digests)
        least = np.full(len(distinct), NO_ID)
        flags = _flags(answers, 2, np.int64)
        for part, rows in enumerate(B.split_by(distinct[:, 0], parts)):
            if part in flags:
                least[rows] = flags[part]
        # Only windows that some document here must lose become patterns.
        lost = np.zeros(len(distinct), bool)
        lost[number[least[number] < held.ids[held.owner[places]]]] = True
        patterns = np.flatnonzero(lost)
        automaton = None
        if len(patterns):
            value = np.full(len(held.hashes), -1)
            value[places] = np.where(lost[number], number, -1)
            automaton = Automaton(held, places[first[patterns]], patterns, value)
        for doc in range(len(held.texts)):
            words = held.texts[doc].encode().split()
            spans = automaton.covered(doc, words, least, int(held.ids[doc])) if automaton else []
            yield _cut(held.doc_ids[doc], words, spans)

    return B.with_answers(dealt, found.union(confirmed), locate, SCHEMA)


class Automaton:
    """Aho-Corasick over a block's words, each written as two letters so that no node has many children.

    A letter pair stands for a word's hash, so all texts of the block become letters at once. The first letters are no
    word's second ones, so matches begin and end with words. The patterns are the anchor phrases of the windows at
    ``places``; ``value`` names the window that may start at each word, and the words decide.
    """

    def __init__(self, held: Words, places: np.ndarray, values: np.ndarray, value: np.ndarray) -> None:
        reach = WINDOW - ANCHOR + 1
        least = held.rolled(ANCHOR, 1)[places[:, None] + np.arange(reach)]
        phrases = places + np.argmin(least, axis=1)
        _, one = np.unique(least.min(axis=1), return_index=True)
        phrases = phrases[one]
        known = np.unique(held.hashes[phrases[:, None] + np.arange(ANCHOR)])
        base = 1
        while base**2 < len(known):
            base += 1
        code = np.arange(len(known) + 1)
        letters = np.stack([0x100 + code // base, 0x20000 + code % base], axis=1).astype("<u4")
        letters[-1] = ord(" ")  # a word of no phrase
        at = np.minimum(np.searchsorted(known, held.hashes), len(known) - 1)
        self.letters = letters[np.where(known[at] == held.hashes, at, len(known))]
        self.start, self.value = held.start, value
        self.words: dict[int, list[bytes]] = {}
        last, split = -1, []
        for place, number in sorted(zip(places.tolist(), values.tolist())):
            doc = int(held.owner[place])
            if doc != last:
                last, split = doc, held.texts[doc].encode().split()
            begin = place - int(held.start[doc])
            self.words[number] = split[begin : begin + WINDOW]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for place in phrases.tolist():
            self.automaton.add_word(self.written(place, place + ANCHOR), place)
        self.automaton.make_automaton()

    def written(self, start: int, end: int) -> str:
        return self.letters[start:end].tobytes().decode("utf-32-le")

    def covered(self, doc: int, words: list[bytes], least: np.ndarray, rank: int) -> list[int]:
        """First and past-last word by turns, of the windows that start in a smaller document."""
        start = int(self.start[doc])
        spans: list[int] = []
        values, next_begin = None, 0
        for last, _ in self.automaton.iter(self.written(start, start + len(words))):
            if values is None:
                values = self.value[start : start + len(words)].tolist()
            phrase = last // 2 + 1 - ANCHOR
            for begin in range(max(next_begin, phrase - WINDOW + ANCHOR), phrase + 1):
                number, end = values[begin], begin + WINDOW
                if number >= 0 and least[number] < rank and words[begin:end] == self.words[number]:
                    if spans and begin <= spans[-1]:
                        spans[-1] = end
                    else:
                        spans += [begin, end]
            next_begin = phrase + 1
        return spans


def _cut(doc_id: int | None, words: list[bytes], spans: list[int]) -> tuple:
    """One document's row, without the words of the spans."""
    kept, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        kept += words[at:a]
        at = b
    kept += words[at:]
    return doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode(), spans
