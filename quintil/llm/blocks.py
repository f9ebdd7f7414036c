"""Blocks of whole documents and the packed exchange between blocks and key ranges.

Documents are dealt to blocks by a hash of their id, so no source or group of copies fills a block. A block asks for
what it needs by sending sorted, distinct keys, packed per key range; a range answers each block in the order it
asked. A key that every document holds is therefore sent once per block, and all sizes in memory are those of a block
or a range, whatever the size of the whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import pyarrow.ipc  # noqa: F401  (pa.ipc)
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
LARGEST_BLOCK = 256 << 20
LEAST_BLOCKS = 48
FLUSH_BYTES = 32 << 20


def pack(values: np.ndarray) -> bytes:
    """Compressed array; the bytes of equal weight are laid side by side."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=5).compress(planes.tobytes())


def unpack(packed: bytes | None, kind: type) -> np.ndarray:
    if not packed:
        return np.empty(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Packed distinct values and packed numbers into them, for values that repeat."""
    distinct, codes = np.unique(values, return_inverse=True)
    return pack(distinct), pack(codes.astype(np.uint32))


def unpack_values(distinct: bytes, codes: bytes, kind: type) -> np.ndarray:
    return unpack(distinct, kind)[unpack(codes, np.uint32)]


def count_blocks(docs: DataFrame, text: str) -> int:
    """Number of blocks for the whole input; blocks grow with the square root of a very large one."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    size = min(LARGEST_BLOCK, max(BLOCK_BYTES, 8 * math.isqrt(total)))
    return max(LEAST_BLOCKS, -(-total // size))


def deal(docs: DataFrame, columns: list[str], key: str, text: str, blocks: int) -> DataFrame:
    """Documents packed as (block, payload).

    Rows without a key are dealt by their text. A task packs what it holds for a block together, compressed, so that
    the one shuffle of a job moves little; passes of the same job share it.
    """
    block = F.pmod(F.xxhash64(F.coalesce(F.hash(docs[key]), F.hash(docs[text])), F.lit(7)), F.lit(blocks))
    source = docs.select(block.alias("block"), *[docs[c].alias(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= FLUSH_BYTES:
                yield from _packed(held)
                held, size = [], 0
        if held:
            yield from _packed(held)

    return source.mapInArrow(run, "block long, payload binary")


def _packed(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches)
    table = table.take(pa.compute.sort_indices(table, [("block", "ascending")])).combine_chunks()
    ids = table.column("block").to_numpy()
    edges = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True]) if len(ids) else []
    rest = table.drop_columns("block")
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=7))
    for a, b in zip(edges[:-1], edges[1:]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema, options=options) as writer:
            writer.write_table(rest.slice(a, b - a))
        row = {"block": pa.array([int(ids[a])]), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())}
        yield pa.RecordBatch.from_pydict(row)


def opened(table: pa.Table) -> pa.Table:
    """Documents of a block's payloads, in a fixed order of payloads."""
    payloads = sorted(table.column("payload").to_pylist())
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in payloads])


def by_block(dealt: DataFrame, work: Callable[[int, pa.Table], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that ``work`` yields for each block's documents."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(table: pa.Table) -> pa.Table:
        return table_of(list(work(table.column("block")[0].as_py(), opened(table))), names, schema)

    return dealt.groupBy("block").applyInArrow(run, schema)


KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}


def table_of(rows: list[tuple], names: list[str], schema: str) -> pa.Table:
    kinds = [KINDS[part.split()[1]] for part in schema.split(",")]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(v, k) for v, k in zip(columns, kinds)], names=names)


def exchange(asked: DataFrame, answer: Callable[[pa.Table], list[tuple]], schema: str) -> DataFrame:
    """Answers of each key range to the rows asked of it; ``asked`` has a column ``part``."""
    names = [part.split()[0] for part in schema.split(",")]
    return asked.groupBy("part").applyInArrow(lambda table: table_of(answer(table), names, schema), schema)


def with_answers(dealt: DataFrame, answers: DataFrame, work: Callable[[pa.Table, pa.Table], list[tuple]], schema: str) -> DataFrame:
    """Each block with the answers it got."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return table_of(list(work(opened(left), right)) if left.num_rows else [], names, schema)

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def split_by(keys: np.ndarray, parts: int) -> list[np.ndarray]:
    """Rows of each key range; keys are well-mixed 64-bit hashes."""
    part = ((keys >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return np.split(order, np.searchsorted(part[order], np.arange(1, parts)))


