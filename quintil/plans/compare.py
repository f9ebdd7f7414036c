"""Comparison of archived runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quintil.functions.scalar import effects_summary, view_summary

OUTPUT_COLUMNS = (
    "comparison_id", "run_id", "experiment_id", "mode", "model", "feature_count", "rows_used", "cv_r2_mean", "cv_r2_std",
    "test_r2", "validation_r2", "test_mae", "validation_mae", "fit_time_seconds", "feature_view_summary",
    "fixed_effects_summary", "canonical_run_dir",
)
METRICS = ("cv_r2_mean", "cv_r2_std", "test_r2", "validation_r2", "test_mae", "validation_mae", "fit_time_seconds")


def manifest_join(metrics: DataFrame, manifests: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """Metric rows with run facts: the manifest's value, else the card's.

    Rows meet on ``directory``. The run id falls back to the directory name.
    """
    facts = manifests.select("directory", F.struct(*[c for c in manifests.columns if c != "directory"]).alias("m"))
    if cards is None:
        cards = manifests.limit(0)
    other = cards.select("directory", F.struct(*[c for c in cards.columns if c != "directory"]).alias("c"))
    joined = metrics.join(facts, "directory", "left").join(other, "directory", "left")

    def first(name: str) -> Column:
        return F.coalesce(F.col(f"m.{name}"), F.col(f"c.{name}"))

    def text(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"m.{name}"), F.lit("")), F.nullif(F.col(f"c.{name}"), F.lit("")))

    effects = F.when(F.size("m.fixed_effects_used") > 0, F.col("m.fixed_effects_used")).otherwise(F.col("c.fixed_effects_used"))
    own_count = F.col("feature_count").cast("long") if "feature_count" in metrics.columns else F.lit(None).cast("long")
    kept = [c for c in metrics.columns if c not in ("directory", "feature_count", "run_id")]
    return joined.select(
        "directory",
        F.coalesce(text("run_id"), F.element_at(F.split("directory", "/"), -1)).alias("run_id"),
        text("experiment_id").alias("experiment_id"),
        text("mode").alias("mode"),
        F.coalesce(own_count, first("feature_count")).alias("feature_count"),
        first("rows_used").alias("rows_used"),
        first("feature_view").alias("feature_view"),
        effects.alias("fixed_effects_used"),
        F.coalesce(
            F.nullif(F.col("m.run_dir"), F.lit("")), F.nullif(F.col("c.canonical_run_dir"), F.lit("")), F.col("directory")
        ).alias("canonical_run_dir"),
        *kept,
    )


def compare_runs(comparison_id: str, metrics: DataFrame, manifests: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """The 17-column comparison of all models of all runs."""
    joined = manifest_join(metrics, manifests, cards)
    missing = [c for c in METRICS if c not in joined.columns]
    wide = joined.withColumns({c: F.lit(None).cast("double") for c in missing}) if missing else joined
    return wide.select(
        F.lit(comparison_id).alias("comparison_id"),
        "run_id", "experiment_id", "mode", "model", "feature_count", "rows_used", *METRICS,
        view_summary("feature_view").alias("feature_view_summary"),
        effects_summary("fixed_effects_used").alias("fixed_effects_summary"),
        "canonical_run_dir",
    ).select(*OUTPUT_COLUMNS)
