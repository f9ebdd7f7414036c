"""Session defaults and helpers for written intermediate results."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest side table, in rows, that a plan may broadcast once it was counted.
BROADCAST_ROWS = 200_000
# Rows of a few numbers for which a written frame gets one partition more.
PARTITION_ROWS = 200_000
# Columns from which on a frame is packed before it is written.
PACKED_COLUMNS = 10
# Types that pass through Arrow as they are; a frame with another one is written as rows.
ARROW_TYPES = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def build_session(app: str = "quintil", **conf: object) -> SparkSession:
    """Session with adaptive execution; cluster settings stay untouched."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Written intermediate results go away with the frames that need them.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; pick a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quintil-checkpoint-"))
    else:
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")


def settle(df: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def settle_packed(df: DataFrame, *parts: Sequence[str]) -> list[DataFrame]:
    """The frame of ``settle``, in the same partitions, and for each list of columns in ``parts`` a frame of these alone.

    Rows of many columns are written as compressed columns of Arrow batches: a checkpoint keeps eight bytes for each number of
    a row, and values of a column pack better together. A part unpacks its columns only.
    """
    wanted = [[c for c in df.columns if c in part] for part in parts]
    if len(df.columns) < PACKED_COLUMNS or not all(isinstance(f.dataType, ARROW_TYPES) for f in df.schema):
        written = settle(df)
        return [written, *[written.select(*[F.col(f"`{c}`") for c in columns]) for columns in wanted]]
    written, schema = settle(df.mapInArrow(_pack, "block binary")), df.schema
    return [
        written.mapInArrow(_unpack([df.columns.index(c) for c in columns]), T.StructType([schema[c] for c in columns]))
        for columns in (df.columns, *wanted)
    ]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])


def _unpack(fields: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                yield from pa.ipc.open_stream(block.as_buffer(), options=pa.ipc.IpcReadOptions(included_fields=fields))

    return unpack


def side_table(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise an aggregated side table; broadcast it only if it is small.

    Beyond ``max_rows`` the frame is returned without a hint, so the join
    shuffles.
    """
    written = settle(df)
    if written.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(written)
    return written


def counted(written: DataFrame, value: Column | None = None) -> int:
    """Rows of a written frame, or the aggregate ``value``, by one task a core and so without a file for each partition."""
    cores = written.sparkSession.sparkContext.defaultParallelism
    return written.coalesce(cores).agg(F.count("*") if value is None else value).first()[0] or 0


def in_few_partitions(written: DataFrame, rows: int) -> DataFrame:
    """A written frame in as many partitions as the counted ``rows``, or entries of its lists, ask for.

    Each shuffle takes a file for each partition that it is made from, whatever these hold.
    """
    return written.coalesce(max(1, -(-rows // PARTITION_ROWS)))
