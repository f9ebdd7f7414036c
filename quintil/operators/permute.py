"""Permutations of group values and of row blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quintil.operators.order import hash_rank, order_rank
from quintil.session import settle, side_table


def group_mode(df: DataFrame, group: str, column: str) -> DataFrame:
    """Most frequent value per group, lowest text on ties: (group, value, n_values).

    NULL is a group and a value of its own. Only the counts per (group, value)
    are ordered, never the rows.
    """
    counts = df.groupBy(group, column).agg(F.count(F.lit(1)).alias("__n"))
    text = F.coalesce(F.col(column).cast("string"), F.lit("<NA>"))
    best = F.min_by(F.struct(F.col(column).alias("v")), F.struct(-F.col("__n"), text))
    return counts.groupBy(group).agg(best.alias("__best"), F.count(F.lit(1)).alias("n_values")).select(
        group, F.col("__best.v").alias("value"), "n_values"
    )


def permuted_values(df: DataFrame, column: str, group: str, seed: int = 42) -> DataFrame:
    """Group value of another group for every group: (group, value, permuted, n_values).

    The i-th group in key order receives the value of the i-th group in shuffled
    order. If the shuffle changes nothing, positions rotate by one.
    """
    keyed = settle(
        group_mode(df, group, column).withColumn("__key", F.coalesce(F.col(group).cast("string"), F.lit("<NA>")))
    )
    n = keyed.count()
    placed = hash_rank(order_rank(keyed, ["__key"], "__i"), "__key", seed, "__j")
    unchanged = placed.agg(F.bool_and(F.col("__i") == F.col("__j"))).first()[0]
    if unchanged and n > 1:
        placed = placed.withColumn("__j", (F.col("__j") + 1) % n)
    givers = placed.select(F.col("__j").alias("__slot"), F.col("value").alias("permuted"))
    return placed.join(givers, F.col("__i") == F.col("__slot")).select(group, "value", "permuted", "n_values")


def group_permutation(df: DataFrame, column: str, group: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Replace a column by its group value of another group; also the mapping."""
    if column not in df.columns or group not in df.columns:
        missing = [c for c in (column, group) if c not in df.columns]
        note = df.sparkSession.range(1).select(F.lit("missing columns: " + ", ".join(missing)).alias("warning"))
        return df, note
    mapping = side_table(permuted_values(df, column, group, seed))
    return permuted_join(df, mapping, column, group), mapping


def permuted_join(df: DataFrame, mapping: DataFrame, column: str, group: str) -> DataFrame:
    """Many-to-one left join on the group; a NULL group matches NULL."""
    renamed = mapping.select(F.col(group).alias("__g"), F.col("permuted").alias("__v"))
    joined = df.join(renamed, df[group].eqNullSafe(F.col("__g")), "left")
    return joined.select(*[F.col("__v").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


def row_permutation(
    df: DataFrame, columns: Sequence[str], seed: int, key: str = "row_id", dense_key: bool = False
) -> DataFrame:
    """Permute a block of columns jointly across rows.

    The i-th row in key order takes the block of the i-th row in shuffled order.
    ``dense_key`` says that the key already is 0..n-1, which saves the ranking.
    """
    block = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__block")
    ranked = df.withColumn("__i", F.col(key)) if dense_key else order_rank(df, [key], "__i")
    givers = hash_rank(df.select(key, block), key, seed, "__j").select("__j", "__block")
    joined = ranked.join(givers, F.col("__i") == F.col("__j"))
    swapped: list[Column] = [
        F.col(f"__block.`{c}`").alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns
    ]
    return joined.select(*swapped)
