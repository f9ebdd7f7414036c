"""Permutation importance of features and feature blocks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintil.ml.linear import LinearFit
from quintil.operators.metrics import error_metrics
from quintil.operators.order import hash_rank, order_rank
from quintil.session import settle


def importance_targets(features: Sequence[str], blocks: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """Blocks first, then the features that belong to none."""
    present = {name: [c for c in columns if c in features] for name, columns in blocks.items()}
    present = {name: columns for name, columns in present.items() if columns}
    grouped = {c for columns in present.values() for c in columns}
    return present | {c: [c] for c in features if c not in grouped}


def _summary(scores: DataFrame, base: Mapping[str, float], sizes: Mapping[str, int]) -> DataFrame:
    """Mean and sample deviation over repeats of the R2 drop and the MAE rise."""
    n_cols = F.create_map(*[F.lit(v) for item in sizes.items() for v in item])
    drop, rise = F.lit(base["r2"]) - F.col("r2"), F.col("mae") - F.lit(base["mae"])
    return (
        scores.groupBy("feature_or_group")
        .agg(
            F.avg(drop).alias("importance_mean"),
            F.stddev_samp(drop).alias("importance_std"),
            F.avg(rise).alias("imp_mae_mean"),
            F.stddev_samp(rise).alias("imp_mae_std"),
        )
        .select(
            "feature_or_group",
            n_cols[F.col("feature_or_group")].alias("n_cols"),
            F.lit(base["r2"]).alias("base_score"),
            "importance_mean",
            "importance_std",
            F.lit(base["mae"]).alias("base_mae"),
            "imp_mae_mean",
            "imp_mae_std",
        )
        .orderBy(F.desc("importance_mean"))
    )


def linear_importance(
    fit: LinearFit,
    test: DataFrame,
    target: str,
    blocks: Mapping[str, Sequence[str]],
    features: Sequence[str],
    repeats: int = 20,
    seed: int = 42,
    key: str = "row_id",
) -> DataFrame:
    """Permutation importance of a linear model.

    A linear prediction is a sum of block contributions, so permuting a block
    only swaps its contribution. Each repeat ranks the rows once under its own
    shuffle and carries all blocks' contributions through one join.
    """
    targets = importance_targets(features, blocks)
    parts = {f"__p{i}": fit.contribution(columns) for i, columns in enumerate(targets.values())}
    scored = test.select(key, F.col(target).alias("__y"), fit.predict_column().alias("__base"), *[c.alias(n) for n, c in parts.items()])
    placed = settle(order_rank(scored, [key], "__i"))
    base = placed.agg(*error_metrics("__y", "__base")).first()
    scores = None
    for repeat in range(repeats):
        givers = hash_rank(placed.select(key, *[F.col(n).alias(f"{n}_new") for n in parts]), key, seed + repeat, "__j").drop(key)
        joined = placed.join(givers, F.col("__i") == F.col("__j"))
        wide = joined.agg(
            *[
                _swapped_metrics(n).alias(f"s{i}")
                for i, n in enumerate(parts)
            ]
        )
        entries = F.array(
            *[F.struct(F.lit(name).alias("feature_or_group"), F.col(f"s{i}.r2").alias("r2"), F.col(f"s{i}.mae").alias("mae")) for i, name in enumerate(targets)]
        )
        one = wide.select(F.explode(entries).alias("e")).select("e.*")
        scores = one if scores is None else scores.unionByName(one)
    return _summary(scores, base.asDict(), {name: len(columns) for name, columns in targets.items()})


def _swapped_metrics(part: str):
    """R2 and MAE after one contribution was swapped, as a struct aggregate."""
    error = F.col("__y") - (F.col("__base") - F.col(part) + F.col(f"{part}_new"))
    total = F.var_pop("__y")
    return F.struct(
        F.when(total > 0, 1.0 - F.avg(error * error) / total).alias("r2"), F.avg(F.abs(error)).alias("mae")
    )


def permutation_importance(
    predict: Callable[[DataFrame], DataFrame],
    test: DataFrame,
    target: str,
    blocks: Mapping[str, Sequence[str]],
    features: Sequence[str],
    repeats: int = 20,
    seed: int = 42,
    key: str = "row_id",
) -> DataFrame:
    """Permutation importance of any model; ``predict`` adds ``y_pred`` and keeps the columns it is given.

    The rows are numbered once. A repeat joins every row with the row that its shuffle puts in its place, and all blocks of
    the repeat are scored as one stacked table, in which a block's rows take their columns from that other row.
    """
    targets = importance_targets(features, blocks)
    own = test.select(key, F.col(target).alias("__y"), *[F.col(f"`{c}`") for c in features])
    placed = settle(order_rank(own, [key], "__i"))
    base = predict(placed).agg(*error_metrics("__y", "y_pred")).first()
    scores = None
    for repeat in range(repeats):
        other = placed.select(key, *[F.col(f"`{c}`").alias(f"__new_{n}") for n, c in enumerate(features)])
        givers = hash_rank(other, key, seed + repeat, "__j").drop(key)
        joined = placed.join(givers, F.col("__i") == F.col("__j"))
        stacked = [
            F.struct(
                F.lit(name).alias("feature_or_group"),
                *[(F.col(f"__new_{n}") if c in columns else F.col(f"`{c}`")).alias(c) for n, c in enumerate(features)],
            )
            for name, columns in targets.items()
        ]
        rows = joined.select("__y", F.explode(F.array(*stacked)).alias("e")).select("__y", "e.*")
        one = predict(rows).groupBy("feature_or_group").agg(*error_metrics("__y", "y_pred"))
        scores = one if scores is None else scores.unionByName(one)
    return _summary(scores, base.asDict(), {name: len(columns) for name, columns in targets.items()})
