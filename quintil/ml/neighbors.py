"""Exact k-nearest-neighbour classification as a pruned block join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quintil.operators.order import hash_order
from quintil.session import settle

PIVOTS = 32
BLOCK_ROWS = 20_000
MATRIX_CELLS = 4_000_000  # numbers in a block of distances
SLACK = 1e-11  # share of the squared lengths above any rounding error of a squared distance by products


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float, copy=False)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((points[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))


def _closest_rows(points: np.ndarray, refs: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, reference, distance) of at least the ``best`` nearest references of each point, those at equal distance included.

    One matrix product gives all squared distances but for rounding; what it cannot rule out is measured by differences.
    """
    own, other = (points * points).sum(axis=1), (refs * refs).sum(axis=1)
    squares = points @ refs.T
    squares *= -2.0
    squares += own[:, None]
    squares += other[None, :]
    edge = np.partition(squares, best - 1, axis=1)[:, best - 1] + SLACK * (own + other.max())
    q, r = np.nonzero(squares <= edge[:, None])
    return q, r, np.sqrt(((points[q] - refs[r]) ** 2).sum(axis=1))


def nearest_neighbors(
    queries: DataFrame,
    references: DataFrame,
    k: int,
    key: str = "vec_id",
    vector: str = "embedding",
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
    seed: int = 42,
) -> DataFrame:
    """The k nearest references of every query: (query, neighbor, distance, position).

    References are assigned to the nearest of a few pivots. The triangle
    inequality bounds a query's k-th distance and rules out cells that lie
    farther away, so a query joins only the remaining cells by equality. Cells
    are cut into blocks of about ``block_rows`` rows; a block returns its own k
    best per query, and the k best of these are final. Nothing is approximated.
    """
    chosen = references.orderBy(hash_order(seed, key)).limit(pivots).select(vector).collect()
    if not chosen:
        raise ValueError("There are no reference vectors.")
    centers = np.array([r[0] for r in chosen], dtype=float)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            points = _matrix(batch["__v"])
            away = _distances(points, centers)
            cell = away.argmin(axis=1)
            yield pd.DataFrame(
                {"__id": batch["__id"], "__v": batch["__v"], "cell": cell.astype("int32"), "radius": away[np.arange(len(cell)), cell]}
            )

    plain = references.select(F.col(key).alias("__id"), F.col(vector).alias("__v"))
    placed = settle(plain.mapInPandas(assign, "__id long, __v array<double>, cell int, radius double"))
    # At most one row per pivot.
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("radius")).collect()
    ids = np.array([r["cell"] for r in cells])
    sizes = np.array([r["n"] for r in cells])
    radii = np.array([r["radius"] for r in cells])
    blocks = np.maximum(1, -(-sizes // block_rows))
    block_map = F.create_map(*[F.lit(int(v)) for i, b in zip(ids, blocks, strict=True) for v in (i, b)])
    ref_blocks = placed.select(
        "cell", F.pmod(F.xxhash64("__id"), block_map[F.col("cell")]).cast("int").alias("block"), "__id", "__v"
    )

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            points = _matrix(batch["__v"])
            away = _distances(points, centers[ids])
            reach = away + radii
            order = reach.argsort(axis=1)
            filled = sizes[order].cumsum(axis=1) >= min(k, sizes.sum())
            first = filled.argmax(axis=1)
            rows = np.arange(len(points))
            bound = reach[rows, order[rows, first]]
            near = away - radii <= bound[:, None] * (1 + 1e-12) + 1e-12
            q, c = np.nonzero(near)
            copies = blocks[c]
            q, c = np.repeat(q, copies), np.repeat(c, copies)
            block = np.concatenate([np.arange(n) for n in copies]) if len(copies) else np.array([], dtype=int)
            yield pd.DataFrame(
                {
                    "cell": ids[c].astype("int32"),
                    "block": block.astype("int32"),
                    "__id": batch["__id"].to_numpy()[q],
                    "__v": batch["__v"].to_numpy()[q],
                }
            )

    routed = queries.select(F.col(key).alias("__id"), F.col(vector).alias("__v")).mapInPandas(
        route, "cell int, block int, __id long, __v array<double>"
    )
    # Queries of a block are split as well, so that no block collects them all.
    query_groups = max(1, -(-queries.count() // block_rows))
    routed = settle(routed.withColumn("part", F.pmod(F.xxhash64("__id"), F.lit(query_groups)).cast("int")))
    # References go only where some query asks for their cell.
    asked = routed.select(F.col("cell").alias("asked"), F.col("part").alias("by")).distinct()
    copies = ref_blocks.join(asked, F.col("cell") == F.col("asked")).select("cell", "block", F.col("by").alias("part"), "__id", "__v")

    def closest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query", "neighbor", "distance"]
        if left.empty or right.empty:
            return pd.DataFrame({n: pd.Series(dtype="float64" if n == "distance" else "int64") for n in names})
        points, refs = (_matrix(side["__v"]) for side in (left, right))
        query_ids, ref_ids = left["__id"].to_numpy(), right["__id"].to_numpy()
        best, rows = min(k, len(refs)), max(1, MATRIX_CELLS // len(refs))
        found = []
        for at in range(0, len(points), rows):
            q, r, away = _closest_rows(points[at : at + rows], refs, best)
            order = np.lexsort((ref_ids[r], away, q))
            q, r, away = q[order], r[order], away[order]
            ahead = np.arange(len(q)) - np.searchsorted(q, q)
            first = ahead < best
            found.append(pd.DataFrame({"query": query_ids[at + q[first]], "neighbor": ref_ids[r[first]], "distance": away[first]}))
        return pd.concat(found, ignore_index=True)

    schema = T.StructType(
        [T.StructField("query", T.LongType()), T.StructField("neighbor", T.LongType()), T.StructField("distance", T.DoubleType())]
    )
    keys = ["cell", "block", "part"]
    local = routed.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(closest, schema)
    position = F.row_number().over(W.partitionBy("query").orderBy("distance", "neighbor"))
    return local.withColumn("position", position).filter(F.col("position") <= k)


def knn_classify(
    queries: DataFrame,
    references: DataFrame,
    k: int = 3,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    **kwargs,
) -> DataFrame:
    """Majority label of the k nearest references, the lowest label on ties."""
    near = nearest_neighbors(queries, references, k, key, vector, **kwargs)
    labels = references.select(F.col(key).alias("neighbor"), F.col(label).alias("__l"))
    votes = near.join(labels, "neighbor").groupBy("query").agg(F.mode("__l", True).alias("predicted"))
    return votes.join(queries.select(F.col(key).alias("query"), F.col(label).alias("actual")), "query").select(
        F.col("query").alias(key), "actual", "predicted"
    )
