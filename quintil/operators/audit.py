"""Data audits of a modelling table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quintil.contract import FORBIDDEN
from quintil.operators.dataset import CATEGORICAL
from quintil.operators.household import COMPOSITION

# Sentinel codes of numeric columns, fixed values.
SPECIAL_CODES: dict[str, list[int]] = {"P03": [111, 112], "H15": [31], "H16": [31]}
GEO_RANKS = ("AGLO_rk", "Reg_rk")


def household_composition_check(df: DataFrame, size: str = "IX_TOT", by: str = "ANO4") -> DataFrame:
    """Share of rows whose age bands add up to the household size, per year."""
    total = sum((F.col(f"`{c}`") for c in COMPOSITION[1:]), F.col(f"`{COMPOSITION[0]}`"))
    match = F.coalesce(total == F.col(size), F.lit(False))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(match).alias("matches"),
        F.avg(match.cast("double")).alias("match_rate"),
    )


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, nulls, distinct values and the count of the commonest one.

    Values are counted once per (column, value) with map-side combining.
    """
    columns = list(columns or df.columns)
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    )
    counts = df.select(F.explode(entries).alias("e")).select("e.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))
    seen = F.col("value").isNotNull()
    return counts.groupBy("column").agg(
        F.sum("c").alias("n"),
        F.coalesce(F.sum(F.when(~seen, F.col("c"))), F.lit(0)).alias("nulls"),
        F.count_if(seen).alias("n_distinct"),
        F.coalesce(F.max(F.when(seen, F.col("c"))), F.lit(0)).alias("top_count"),
    )


def feature_audit(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    forbidden: Mapping[str, Sequence[str]] = FORBIDDEN,
    near_constant: float = 0.99,
) -> DataFrame:
    """Type, null rate, distinct values and warning flags per column."""
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    banned = {c for group in forbidden.values() for c in group}
    role = {c: "categorical" if c in CATEGORICAL or types[c] == "string" else "numeric" for c in columns}

    def lookup(values: Mapping[str, object]) -> Column:
        return F.create_map(*[F.lit(v) for item in values.items() for v in item])[F.col("column")]

    filled = F.col("n") - F.col("nulls")
    return column_profile(df, columns).select(
        "column",
        lookup(role).alias("role"),
        "n",
        F.try_divide(F.col("nulls"), F.col("n")).alias("null_rate"),
        "n_distinct",
        (F.col("n_distinct") <= 1).alias("is_constant"),
        F.coalesce(F.col("top_count") >= near_constant * filled, F.lit(True)).alias("near_constant"),
        F.col("column").isin(*banned).alias("forbidden"),
        F.col("column").isin(*GEO_RANKS).alias("geo_rank"),
    )


def forbidden_audit(
    profiles: DataFrame, forbidden: Mapping[str, Sequence[str]] = FORBIDDEN
) -> DataFrame:
    """Forbidden predictors found in column profiles: an empty result passes.

    ``profiles`` carries (column, n, nulls) and may also carry ``table``.
    """
    contract = [(g, c) for g, columns in forbidden.items() for c in (columns or ())]
    rows = F.array(*[F.struct(F.lit(g).alias("leakage_group"), F.lit(c).alias("__c")) for g, c in contract])
    table = profiles.sparkSession.range(1).select(F.explode(rows).alias("e")).select("e.*")
    keys = [c for c in ("table",) if c in profiles.columns]
    return (
        profiles.join(F.broadcast(table), F.col("column") == F.col("__c"))
        .select(*keys, "leakage_group", "column", F.try_divide(F.col("n") - F.col("nulls"), F.col("n")).alias("non_null_share"))
        .orderBy(*keys, "leakage_group", "column")
    )


def special_code_audit(df: DataFrame, codes: Mapping[str, Sequence[int]] = SPECIAL_CODES) -> DataFrame:
    """Rows per declared sentinel code, all columns in one pass."""
    listed = [(c, code) for c, values in codes.items() if c in df.columns for code in values]
    totals = df.agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c) == code).alias(f"k{i}") for i, (c, code) in enumerate(listed)]
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(code).alias("code"), F.col(f"k{i}").alias("n"))
            for i, (c, code) in enumerate(listed)
        ]
    )
    return totals.select("__n", F.explode(entries).alias("e")).select(
        "e.*", F.try_divide(F.col("e.n"), F.col("__n")).alias("share")
    )


def cardinality_audit(df: DataFrame, columns: Sequence[str], rare_below: int = 30) -> DataFrame:
    """Levels, smallest and largest level and rare levels per column."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.explode(entries).alias("e")).select("e.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))
    return (
        counts.filter(F.col("value").isNotNull())
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("levels"),
            F.min("c").alias("min_rows_per_level"),
            F.max("c").alias("max_rows_per_level"),
            F.count_if(F.col("c") < rare_below).alias("rare_levels"),
        )
        .withColumn("declared_categorical", F.col("column").isin(*CATEGORICAL))
    )
