"""Benchmark passages in documents by pigeonhole edit matching.

Texts are compared as lower-cased words joined by single spaces. A test item may occur with up to ``rate`` edits a
character. With e errors allowed it is cut into e + 1 pieces, of which any occurrence holds one unchanged; an
Aho-Corasick automaton over all pieces finds these. A hit is verified upwards: pieces are joined two by two, a join of
j pieces may have j - 1 errors, and by the same pigeonhole some hit of every occurrence passes at each level. Each level
is a Myers bit-parallel distance, so chance hits end at short patterns.

Items of fewer than ``min_words`` words are no evidence and are left out. Null texts and null items match nothing; an
item that occurs twice in the table is reported under each of its ids. Items are compiled in shards of at most
``SHARD_CHARS`` characters, each of which streams over all documents.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 0.1
MIN_WORDS = 5
SHARD_CHARS = 8 << 20
WORDS = re.compile(r"\w+")


def normal(text: str | None) -> str:
    return " ".join(WORDS.findall((text or "").lower()))


class Pattern:
    """Bit masks of a pattern for Myers' algorithm, forwards and backwards."""

    def __init__(self, text: str) -> None:
        self.text, self.size = text, len(text)
        self.masks, self.back = self._masks(text), None

    @staticmethod
    def _masks(text: str) -> dict[str, int]:
        masks: dict[str, int] = {}
        for i, c in enumerate(text):
            masks[c] = masks.get(c, 0) | 1 << i
        return masks

    def ends(self, window: str, most: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
        """(distance, end) of the best occurrence in the window within ``most`` errors, the last of equals; None without one."""
        get = (self.masks if masks is None else masks).get
        size = self.size
        full, top = (1 << size) - 1, 1 << (size - 1)
        plus, minus, distance, best = full, 0, size, None
        if distance <= most:
            best = (distance, 0)
        for place, c in enumerate(window):
            eq = get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | (full & ~(xh | plus))
            mh = plus & xh
            if ph & top:
                distance += 1
            elif mh & top:
                distance -= 1
            ph = (ph << 1) & full
            plus = ((mh << 1) & full) | (full & ~(xv | ph))
            minus = ph & xv
            if distance <= most and (best is None or distance <= best[0]):
                best = (distance, place + 1)
        return best

    def starts(self, window: str, most: int) -> int:
        """Start of the best occurrence that ends with the window; the shortest of equals."""
        if self.back is None:
            self.back = self._masks(self.text[::-1])
        get, size = self.back.get, self.size
        full, top = (1 << size) - 1, 1 << (size - 1)
        plus, minus, distance, best = full, 0, size, (size, 0)
        for place, c in enumerate(reversed(window)):
            eq = get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | (full & ~(xh | plus))
            mh = plus & xh
            if ph & top:
                distance += 1
            elif mh & top:
                distance -= 1
            ph = (ph << 1 | 1) & full  # the occurrence is tied to this end
            plus = ((mh << 1) & full) | (full & ~(xv | ph))
            minus = ph & xv
            if distance < best[0]:
                best = (distance, place + 1)
        return len(window) - best[1]


class Item:
    """An item's pieces and the joins above them; joins[0] is the whole item."""

    def __init__(self, item_id: int, text: str, rate: float) -> None:
        self.item_id, self.errors = item_id, int(len(text) * rate)
        count = self.errors + 1
        cuts = [len(text) * i // count for i in range(count + 1)]
        self.whole = Pattern(text)
        self.pieces = [(cuts[i], text[cuts[i] : cuts[i + 1]]) for i in range(count)]
        self.paths: list[list[tuple[int, int, Pattern]]] = [[] for _ in range(count)]
        level = [(i, i + 1) for i in range(count)]
        while len(level) > 1:
            level = [(level[i][0], level[min(i + 1, len(level) - 1)][1]) for i in range(0, len(level), 2)]
            for a, b in level:
                pattern = self.whole if b - a == count else Pattern(text[cuts[a] : cuts[b]])
                for piece in range(a, b):
                    path = self.paths[piece]
                    if not path or path[-1][2].size < pattern.size:
                        path.append((cuts[a], b - a - 1, pattern))

    def verify(self, text: str, at: int, piece: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of an occurrence around a piece found at ``at``."""
        offset = self.pieces[piece][0]
        for begin, errors, pattern in self.paths[piece]:
            low = max(0, at - (offset - begin) - errors)
            high = min(len(text), at + pattern.size - (offset - begin) + errors)
            found = pattern.ends(text[low:high], errors)
            if found is None:
                return None
        if not self.paths[piece]:
            return 0, at, at + self.whole.size
        distance, end = found[0], low + found[1]
        low = max(0, end - self.whole.size - self.errors)
        return distance, low + self.whole.starts(text[low:end], distance), end


class Matcher:
    """The automaton over the pieces of one shard of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [Item(i, t, rate) for i, t in items]
        owners: dict[str, list[tuple[int, int]]] = {}
        for number, item in enumerate(self.items):
            for piece, (_, text) in enumerate(item.pieces):
                owners.setdefault(text, []).append((number, piece))
        self.automaton = ahocorasick.Automaton()
        for text, owner in owners.items():
            self.automaton.add_word(text, (len(text), owner))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def occurrences(self, text: str) -> dict[int, list[tuple[int, int, int]]]:
        """For each item number its occurrences (distance, start, end) in a normal text."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        if self.empty:
            return found
        for last, (size, owners) in self.automaton.iter(text):
            at = last - size + 1
            for number, piece in owners:
                known = found.get(number)
                if known and any(s <= at < e for _, s, e in known[-3:]):
                    continue
                hit = self.items[number].verify(text, at, piece)
                if hit is not None and not (known and hit in known):
                    found.setdefault(number, []).append(hit)
        return found


def _places(text: str) -> tuple[list[int], list[int], list[int]]:
    """(start of each word in the normal text, its start and its end in the raw text)."""
    starts, raw, ends, at = [], [], [], 0
    for m in WORDS.finditer(text):
        starts.append(at)
        raw.append(m.start())
        ends.append(m.end())
        at += len(m.group().lower()) + 1
    return starts, raw, ends


_LOADED: dict[tuple, Matcher] = {}


def _matcher(items: list[tuple[int, str]], rate: float) -> Matcher:
    mark = (rate, tuple(items))
    if mark not in _LOADED:
        _LOADED.clear()
        _LOADED[mark] = Matcher(items, rate)
    return _LOADED[mark]


def _shards(benchmark: DataFrame, item_key: str, text: str, min_words: int) -> Iterator[list[tuple[int, str]]]:
    """Items in shards of bounded size, read one after the other."""
    held, size = [], 0
    for row in benchmark.select(benchmark[item_key].alias("i"), benchmark[text].alias("t")).toLocalIterator():
        plain = normal(row["t"])
        if plain.count(" ") + 1 < min_words or row["i"] is None:
            continue
        if held and size + len(plain) > SHARD_CHARS:
            yield sorted(held)
            held, size = [], 0
        held.append((row["i"], plain))
        size += len(plain)
    yield sorted(held)


def matches(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", rate: float = RATE, min_words: int = MIN_WORDS
) -> DataFrame:
    """(key, item_key, distance, start, end): every occurrence, with its characters in the raw text."""
    schema = T.StructType(
        [
            T.StructField(key, docs.schema[key].dataType),
            T.StructField(item_key, T.LongType()),
            T.StructField("distance", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
    source, found = docs.select(docs[key].alias("key"), docs[text].alias("text")), None
    for shard in _shards(benchmark, item_key, text, min_words):

        def run(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]] = shard) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(items, rate)
            for batch in batches:
                rows: list[list] = [[], [], [], [], []]
                for doc, value in zip(batch.column(0), batch.column(1)):
                    raw = value.as_py() or ""
                    hits = matcher.occurrences(normal(raw))
                    if not hits:
                        continue
                    starts, begins, ends = _places(raw)
                    for number, spans in hits.items():
                        for distance, a, b in spans:
                            first, last = bisect_right(starts, a) - 1, bisect_right(starts, max(b - 1, a)) - 1
                            for column, v in zip(rows, (doc.as_py(), matcher.items[number].item_id, distance, begins[first], ends[last])):
                                column.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0], batch.schema.field(0).type), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64())],
                    names=[key, item_key, "distance", "start", "end"],
                )

        part = source.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """One row for each document and item: the number of occurrences, and the closest with its place."""
    key, item_key = options.get("key", "doc_id"), options.get("item_key", "item_id")
    closest = F.min(F.struct("distance", "start", "end"))
    grouped = matches(docs, benchmark, **options).groupBy(key, item_key).agg(F.count("*").alias("n_occurrences"), closest.alias("c"))
    return grouped.select(key, item_key, "n_occurrences", "c.distance", "c.start", "c.end")
