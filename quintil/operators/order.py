"""Total orders at scale: ranks, cut points and row identifiers.

The seeded shuffle of this library is the order of
``md5(seed ':' key)``: uniform, reproducible and independent of partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quintil.session import settle, settle_packed

HASH_DIGITS = 4
# monotonically_increasing_id keeps the partition in the bits above this one.
_PARTITION_SHIFT = 33


def hash_order(seed: int, *keys: str) -> Column:
    """Sort key of the seeded shuffle; keys are cast to text first."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of two frames on the named keys."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def hash_rank(df: DataFrame, key: str, seed: int, name: str = "rank", digits: int = HASH_DIGITS) -> DataFrame:
    """0-based position of every row in the seeded shuffle.

    Rows are bucketed by the first hex digits of the hash, so buckets are even
    and at most ``16 ** digits`` offsets are broadcast.
    """
    hashed = df.withColumn("__h", hash_order(seed, key)).withColumn("__b", F.substring("__h", 1, digits))
    sizes = hashed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = W.partitionBy("__b").orderBy("__h", key)
    return (
        hashed.withColumn("__pos", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "__b")
        .withColumn(name, (F.col("__before") + F.col("__pos")).cast("long"))
        .drop("__b", "__h", "__pos", "__before")
    )


def hash_cuts(
    df: DataFrame,
    key: str,
    seed: int,
    wanted: Mapping[str, Callable[[Column], Column]],
    within: Sequence[str] = (),
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Hash value found at chosen positions of the seeded shuffle.

    ``wanted`` maps a cut name to a function of the row count that gives a
    0-based position. One row per ``within`` group comes back, with the hash at
    that position, or NULL when the position lies past the end. Rows whose hash
    is below the cut are exactly the first ``position`` rows, so a caller splits
    a table by comparing hashes and never sorts it.
    """
    groups = list(within)
    hashed = df.select(*groups, hash_order(seed, key).alias("__h")).withColumn(
        "__b", F.substring("__h", 1, digits)
    )
    sizes = hashed.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__n"))
    ordered = W.partitionBy(*groups).orderBy("__b") if groups else W.orderBy("__b")
    whole = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(1))
    sizes = sizes.select(
        *groups,
        "__b",
        "__n",
        F.coalesce(F.sum("__n").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(whole).alias("__total"),
    )
    targets = [
        F.struct(
            F.lit(name).alias("cut"),
            (position(F.col("__total")).cast("long") - F.col("__before")).alias("pos"),
        )
        for name, position in wanted.items()
    ]
    hits = (
        sizes.select(*groups, "__b", "__n", F.explode(F.array(*targets)).alias("__t"))
        .filter((F.col("__t.pos") >= 0) & (F.col("__t.pos") < F.col("__n")))
        .select(
            *[F.col(g).alias(f"__g_{g}") for g in groups],
            F.col("__b").alias("__hit"),
            F.col("__t.cut").alias("__cut"),
            F.col("__t.pos").alias("__pos"),
        )
    )
    condition = hashed["__b"] == hits["__hit"]
    for group in groups:
        condition = condition & hashed[group].eqNullSafe(hits[f"__g_{group}"])
    # Only the buckets that hold a cut are sorted: one in 16 ** digits rows per cut.
    inside = hashed.join(hits if groups else F.broadcast(hits), condition)
    ranked = inside.withColumn(
        "__rn", F.row_number().over(W.partitionBy(*groups, "__cut", "__b").orderBy("__h")) - 1
    ).filter(F.col("__rn") == F.col("__pos"))
    values = [F.max(F.when(F.col("__cut") == name, F.col("__h"))).alias(name) for name in wanted]
    if not groups:
        return ranked.agg(*values)
    return ranked.groupBy(*groups).agg(*values)


def order_rank(
    df: DataFrame,
    by: Sequence[str],
    name: str = "rank",
    keys: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """0-based position under an explicit total order, per group of ``keys``.

    Rows are range-partitioned on (keys, order), sorted inside partitions and
    written once; a partition's offset comes from the counts of the partitions
    before it. A group of any size spreads over as many range partitions as it
    needs, so no single task sorts a whole group.
    """
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = list(keys)
    placed = (
        df.repartitionByRange(count, *keys, *by)
        .sortWithinPartitions(*keys, *by)
        .withColumn("__mid", F.monotonically_increasing_id())
    )
    # Range bounds come from a sample, so both uses below must read one written copy.
    part = F.shiftright("__mid", _PARTITION_SHIFT).alias("__part")
    written, places = (x.select("*", part) for x in settle_packed(placed, [*keys, "__mid"]))
    runs = places.groupBy(*keys, "__part").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first")
    )
    earlier = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy("__part")
    offsets = runs.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__part").alias("__p"),
        "__first",
        F.coalesce(F.sum("__n").over(earlier.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    condition = written["__part"] == offsets["__p"]
    for key in keys:
        condition = condition & written[key].eqNullSafe(offsets[f"__k_{key}"])
    # Without keys there is one offset row per partition, which bounds the broadcast.
    joined = written.join(offsets if keys else F.broadcast(offsets), condition)
    rank = F.col("__before") + F.col("__mid") - F.col("__first")
    return joined.select(*df.columns, rank.cast("long").alias(name))


def running_counts(df: DataFrame, value: str, weight: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of ``weight`` over strictly smaller values, for rows unique on (keys, value).

    Adds ``before``. Used for average ranks and rank sums: ties are combined
    first, so a hot value is one row.
    """
    return _running_sums(df, value, {"before": weight}, keys)


def average_ranks(df: DataFrame, value: str, weights: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Each weight, a count of equal values, becomes the mean rank from 1 of these values; rows are unique on (keys, value).

    The rank is null where the count is zero.
    """
    summed = _running_sums(df, value, {f"__before_{w}": w for w in weights}, keys)
    ranks = [F.when(F.col(w) > 0, F.col(f"__before_{w}") + (F.col(w) + 1) / 2).alias(w) for w in weights]
    return summed.select(*keys, value, *ranks)


def _running_sums(df: DataFrame, value: str, sums: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    spark = df.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(count, *keys, value)
        .withColumn("__part", F.spark_partition_id())
    )
    written = settle(placed)
    runs = written.groupBy(*keys, "__part").agg(*[F.sum(w).alias(f"__w_{n}") for n, w in sums.items()])
    earlier = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = runs.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        F.col("__part").alias("__p"),
        *[F.coalesce(F.sum(f"__w_{n}").over(earlier), F.lit(0)).alias(f"__base_{n}") for n in sums],
    )
    local = W.partitionBy(*keys, "__part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    stepped = written.select("*", *[F.coalesce(F.sum(w).over(local), F.lit(0)).alias(f"__local_{n}") for n, w in sums.items()])
    condition = stepped["__part"] == offsets["__p"]
    for key in keys:
        condition = condition & stepped[key].eqNullSafe(offsets[f"__k_{key}"])
    joined = stepped.join(offsets if keys else F.broadcast(offsets), condition)
    return joined.select(*df.columns, *[(F.col(f"__base_{n}") + F.col(f"__local_{n}")).alias(n) for n in sums])


def add_row_id(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Dense 0..n-1 row identifier under an explicit key order."""
    ranked = order_rank(df, order, name)
    return ranked.select(name, *df.columns)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return starts, np.diff(np.r_[starts, len(values)])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(partition, group, values, rows) of each group that a partition holds."""
    held = [b for b in batches if b.num_rows]
    if held:
        group, value, row, part = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
        for start, size in zip(*_runs(group)):
            yield int(part[0]), int(group[start]), value[start : start + size], row[start : start + size]


def average_rank_of_rows(long: DataFrame) -> DataFrame:
    """(grp, row, avg_rank) of rows (grp int, value double, row long): rank from 1 within the group, the mean for ties.

    One range sort by group, value and row, so that neither a group nor a value shared by many rows fills a partition. Ties
    and counts that go on over a partition's edge are completed from one row per partition and group in it.
    """
    placed = long.select("grp", "value", "row").repartitionByRange("grp", "value", "row").sortWithinPartitions("grp", "value", "row")
    placed = settle(placed.select("*", F.spark_partition_id().alias("part")))

    def edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for part, group, values, _ in _segments(batches):
            _, sizes = _runs(values)
            rows.append((part, group, len(values), values[0], sizes[0], values[-1], sizes[-1]))
        names = ["part", "grp", "n", "first", "first_run", "last", "last_run"]
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    edges = placed.mapInArrow(edge, "part int, grp int, n long, first double, first_run long, last double, last_run long").collect()
    begins, first_runs, last_runs = _edge_runs(sorted(edges, key=lambda e: (e.grp, e.part)))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group, values, rows in _segments(batches):
            starts, sizes = _runs(values)
            before, counts = begins[part, group] + starts, sizes.copy()
            before[0], counts[0] = first_runs[part, group]
            before[-1], counts[-1] = last_runs[part, group]
            ranks = np.repeat(before + (counts + 1) / 2, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), group, np.int32)), pa.array(rows), pa.array(ranks)], ["grp", "row", "avg_rank"])

    return placed.mapInArrow(rank, "grp int, row long, avg_rank double")


def _edge_runs(edges: Sequence) -> tuple[dict, dict, dict]:
    """Per (partition, group): rows before it, and (rows before, length) of its first and of its last run as a whole."""
    begins, first_runs, last_runs = {}, {}, {}
    group, value, seen, run = None, None, 0, [0, 0]
    for e in edges:
        if e.grp != group:
            group, value, seen = e.grp, None, 0
        place = (e.part, e.grp)
        begins[place] = seen
        if e["first"] != value:
            run = [seen, 0]
        run[1] += e.first_run
        first_runs[place] = run
        if e.first_run < e.n:
            run = [seen + e.n - e.last_run, e.last_run]
        last_runs[place] = run
        value, seen = e["last"], seen + e.n
    return begins, first_runs, last_runs
