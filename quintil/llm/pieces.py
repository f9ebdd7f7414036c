"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by piece score, then by place, and merges until no
pair forms a piece. Long segments have a heap each; the short ones of a batch keep their agendas side by side in one
array, from which each round takes every segment's best pair. Symbols that are no piece fall back to byte pieces. Merging never crosses a segment border
that no piece contains, so each distinct segment is worked out once per worker and remembered. Every new segment
of an Arrow batch is checked against the sentencepiece library, and the segments that it encodes otherwise are
counted in ``n_differing``; the agenda's ids stand.

Null and empty texts give the end id alone. Whole texts are encoded, however long. The output has one row per
input row, repeated rows included; other columns of the input are kept unless their names clash with an output column.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
OUTPUT = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_differing long"
CACHE_ENTRIES = 700_000
SHORT = 48  # characters up to which a segment takes part in the shared rounds


class Segmenter:
    """One vocabulary file: pieces, scores and the remembered segments."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        sp, size = self.library, self.library.vocab_size()
        self.eos = sp.eos_id()
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}  # byte value -> id
        self.values: dict[int, int] = {}  # id -> byte value
        self.strings: dict[int, str] = {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes[value], self.values[i] = i, value
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.scores[piece], self.ids[piece] = sp.get_score(i), i
                self.strings[i] = piece.replace(SPACE, " ")
        inside = {c for p in self.scores if len(p) > 1 for c in p}
        borders = {a + b for p in self.scores for a, b in zip(p, p[1:])}
        self.splits_words = not any(b[1] == SPACE != b[0] for b in borders)
        line = "" if "\n" in inside else "\n"
        self.pattern = re.compile(f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + ("|\n" if line else ""))
        self.cache: dict[str, str] = {}
        self.differing: set[str] = set()
        self.marker = sp.encode("\n", add_eos=False)
        self.id_strings = [str(i) for i in range(size)]
        self.plain_strings = {str(i): self.strings.get(i, "") for i in range(size) if i not in self.values}
        self.plain_strings |= {str(i): chr(b) for i, b in self.values.items() if b < 128}  # whole characters by themselves
        self._pair_table(size)

    def _pair_table(self, size: int) -> None:
        """Numbers for symbols (piece ids, then characters that are only parts of pieces) and all pairs that merge."""
        number = dict(self.ids)
        for c in sorted({c for p in self.scores for c in p} - set(number)):
            number[c] = size + len(number) - len(self.ids)
        self.other = size + len(number)  # any character that no piece contains
        self.of_char = np.full(0x110000, self.other, np.int64)
        for symbol, n in number.items():
            if len(symbol) == 1:
                self.of_char[ord(symbol)] = n
        order = {s: r for r, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        found = []
        for piece, score in self.scores.items():
            for cut in range(1, len(piece)):
                a, b = number.get(piece[:cut]), number.get(piece[cut:])
                if a is not None and b is not None:
                    found.append((a << 24 | b, order[score], number[piece]))
        pairs = np.array(sorted(found) or np.empty((0, 3)), np.int64).reshape(-1, 3)
        self.pair_keys = pairs[:, 0].copy()
        self.pair_rank = np.append(pairs[:, 1], np.iinfo(np.int64).max)
        self.pair_piece = np.append(pairs[:, 2], -1)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair in the table, or the row past its end."""
        keys, none = left << 24 | right, len(self.pair_keys)
        if not none:
            return np.zeros(len(keys), np.int64)
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[np.minimum(at, none - 1)] == keys, at, none)

    def merge_many(self, segments: list[str]) -> list[list[int] | None]:
        """Ids of short segments, all agendas in one array; None where a symbol needs the byte pieces."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        symbols = self.of_char[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        owner = np.repeat(np.arange(len(segments)), lengths)
        none, out = len(self.pair_keys), [None] * len(segments)
        pairs = np.full(len(symbols), none)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs[inner] = self._pairs(symbols[inner], symbols[inner + 1])
        limit = len(self.id_strings)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[first, len(symbols)])
            rank = self.pair_rank[pairs]
            best = np.minimum.reduceat(rank, first)
            open_ = best < self.pair_rank[-1]
            for f, n in zip(first[~open_].tolist(), size[~open_].tolist()):
                ids = symbols[f : f + n]
                out[owner[f]] = ids.tolist() if ids.max() < limit else None
            stay = np.repeat(open_, size)
            top = np.flatnonzero(stay & (rank == np.repeat(best, size)))
            top = top[np.r_[True, owner[top][1:] != owner[top][:-1]]] if len(top) else top
            symbols[top] = self.pair_piece[pairs[top]]
            stay[top + 1] = False
            pairs[top] = none
            at = (np.cumsum(stay) - 1)[top]
            symbols, owner, pairs = symbols[stay], owner[stay], pairs[stay]
            for left in (at, at - 1):
                left = left[(left >= 0) & (left + 1 < len(symbols))]
                same = owner[left] == owner[left + 1]
                pairs[left] = np.where(same, self._pairs(symbols[left], symbols[left + 1]), none)
        return out

    def merge(self, segment: str) -> list[str]:
        """Pieces of a segment by the agenda."""
        symbols = list(segment)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        scores, agenda = self.scores, []
        for i in range(n - 1):
            score = scores.get(symbols[i] + symbols[i + 1])
            if score is not None:
                agenda.append((-score, i, i + 1, symbols[i] + symbols[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or after[left] != right or len(a) + len(b) != len(piece):
                continue
            symbols[left], symbols[right] = piece, ""
            behind = after[left] = after[right]
            if behind < n:
                before[behind] = left
                joined = piece + symbols[behind]
                if (score := scores.get(joined)) is not None:
                    heapq.heappush(agenda, (-score, left, behind, joined))
            ahead = before[left]
            if ahead >= 0:
                joined = symbols[ahead] + piece
                if (score := scores.get(joined)) is not None:
                    heapq.heappush(agenda, (-score, ahead, left, joined))
        return [s for s in symbols if s]

    def to_ids(self, segment: str) -> list[int]:
        whole = self.ids.get(segment)
        if whole is not None and len(segment) == 1:
            return [whole]
        out: list[int] = []
        for piece in self.merge(segment):
            found = self.ids.get(piece)
            if found is None:
                out.extend(self.bytes[b] for b in piece.encode())
            else:
                out.append(found)
        return out

    def to_text(self, ids: list[int]) -> str:
        """Text of ids without control ids; runs of byte pieces are read as UTF-8. Keeps the space of the dummy prefix."""
        parts, pending = [], bytearray()
        for i in ids:
            if i in self.values:
                pending.append(self.values[i])
                continue
            if pending:
                parts.append(pending.decode(errors="replace"))
                pending = bytearray()
            parts.append(self.strings.get(i, ""))
        if pending:
            parts.append(pending.decode(errors="replace"))
        return "".join(parts)

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return self.pattern.findall(marked) if self.splits_words else [marked]

    def learn(self, fresh: list[str]) -> None:
        """Encode segments not yet known; one call to the library checks them, and differences are marked."""
        short = [s for s in fresh if len(s) <= SHORT]
        own = dict(zip(short, self.merge_many(short)))
        plain = [s[1:].replace(SPACE, " ") if s[0] == SPACE else "\n" + s for s in fresh]
        names, marker = self.id_strings, len(self.marker)
        for segment, sure in zip(fresh, self.library.encode(plain, num_threads=1)):
            ids = own.get(segment) or self.to_ids(segment)
            if segment == SPACE:  # the library adds no prefix to an empty text
                sure = ids
            elif segment[0] != SPACE:
                sure = sure[marker:]
            if ids != sure:
                self.differing.add(segment)
            self.cache[segment] = " ".join([names[i] for i in ids])

    def encode_batch(self, texts: list[str | None]) -> list[tuple[str, str, int]]:
        """(ids as text, decoded text, segments that the library encodes otherwise) for each text."""
        split = [self.segments(t or "") for t in texts]
        cache = self.cache
        wanted = set().union(*split)
        fresh = list(wanted.difference(cache))
        if len(cache) + len(fresh) > CACHE_ENTRIES:
            cache.clear()
            self.differing.clear()
            fresh = list(wanted)
        if fresh:
            self.learn(fresh)
        out = []
        for segments in split:
            ids = " ".join([*map(cache.__getitem__, segments), self.id_strings[self.eos]])
            wrong = sum(s in self.differing for s in segments) if self.differing else 0
            out.append((ids, self.decode_ids(ids), wrong))
        return out

    def decode_ids(self, ids: str) -> str:
        """Text of ids written as decimals, without the space of the dummy prefix."""
        split = ids.split(" ")
        try:
            return "".join(map(self.plain_strings.__getitem__, split))[1:]
        except KeyError:  # parts of characters
            return self.to_text(list(map(int, split)))[1:]


_LOADED: dict[str, Segmenter] = {}


def segmenter(model_file: str) -> Segmenter:
    """The worker's segmenter for a file; kept while the worker lives."""
    if model_file not in _LOADED:
        _LOADED.clear()
        _LOADED[model_file] = Segmenter(model_file)
    return _LOADED[model_file]


def _groups(column: pa.Array, most: int = 1_000_000) -> Iterator[list[str | None]]:
    """Slices of a text column of about ``most`` characters; a longer text is a slice by itself."""
    held, size = [], 0
    for value in column:
        held.append(value.as_py())
        size += len(held[-1] or "")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, model_file: str, text: str = "text", with_output: bool = False) -> DataFrame:
    """Encode and decode every text; adds the digests, and with ``with_output`` the columns token_ids and decoded."""
    added = ["n_tokens", "ids_sha256", "decoded_sha256", "n_differing"] + (["token_ids", "decoded"] if with_output else [])
    kept = [c for c in docs.columns if c not in added and (c != text or with_output)]
    source = docs.select(*[docs[c] for c in kept], *([] if text in kept else [docs[text]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = segmenter(model_file)
        for batch in batches:
            rows = [r for group in _groups(batch.column(text)) for r in _digests(model, group, with_output)]
            columns = list(zip(*rows)) if rows else [[] for _ in added]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.string()]
            arrays = [batch.column(c) for c in kept] + [pa.array(v, k) for v, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, kept + added)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in kept)
    extra = ", token_ids array<int>, decoded string" if with_output else ""
    return source.mapInArrow(run, (schema + ", " if schema else "") + OUTPUT + extra)


def _digests(model: Segmenter, texts: list[str | None], with_output: bool) -> list[tuple]:
    rows = []
    for ids, decoded, wrong in model.encode_batch(texts):
        row = (ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), wrong)
        rows.append(row + ([int(i) for i in ids.split(" ")], decoded) if with_output else row)
    return rows
