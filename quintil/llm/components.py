"""Connected components by alternating large and small stars over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintil.session import in_few_partitions, settle


def _state(edges: DataFrame) -> tuple:
    cores = edges.sparkSession.sparkContext.defaultParallelism
    return tuple(edges.coalesce(cores).agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _both(edges: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """(u, v): two edges of each row, named by their columns; unlike a union this keeps the partitions."""
    pairs = [F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in (first, second)]
    return edges.select(F.explode(F.array(*pairs)).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex ties its larger neighbours to the smallest of its neighbours and itself."""
    both = _both(edges, ("u", "v"), ("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    tied = both.where("v > u").join(least, "u")
    return tied.select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex ties itself and its smaller neighbours to the smallest of them; here u > v in every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return _both(edges.join(least, "u"), ("u", "least"), ("v", "least")).where("u > v").distinct()


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(u, v): every vertex that is not the smallest of its component, with that smallest vertex.

    ``edges`` has two columns of one ordered type; loops and rows with nulls are ignored, repeated and reversed edges
    count once. Each round is written to the shared folder, so a lost executor costs one round at most. Edges are counted
    each round and lie in as many partitions as they ask for, so that a round of few edges writes few files.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns)
    now = settle(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(now)
    now = in_few_partitions(now, state[0])
    while state[0]:
        after = settle(_small_star(_large_star(now)))
        reached = _state(after)
        if reached == state:
            break
        now, state = in_few_partitions(after, reached[0]), reached
    return now
