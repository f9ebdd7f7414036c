"""All diagnostics of a run, from its stored predictions and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintil.operators import explore, metrics, selection
from quintil.session import settle


def decile_curves(by_decile: DataFrame, split: str) -> DataFrame:
    """Error and mean residual by income decile, one line per model."""
    rows = by_decile.filter((F.col("split") == split) & F.col("income_decile").isNotNull())
    return rows.select("model", "income_decile", "mae", "residual_mean").orderBy("model", "income_decile")


def sweep_tables(
    cv_results: DataFrame, sweep_type: str | None, primary: str | None, group: str | None = None, run_id: str | None = None
) -> dict[str, DataFrame]:
    """Summary, curve and report of a boosted-tree sweep, if the config names one."""
    if sweep_type not in ("hgb_lr_iter", "hgb_single_param") or not primary:
        return {}
    summary = settle(selection.sweep_summary(cv_results, run_id))
    return {
        "sweep_summary": summary,
        "sweep_curve": selection.sweep_curve(summary, primary, group),
        "top_configs": selection.top_configs(summary),
        "overfit_gap_by_config": selection.by_overfit_gap(summary),
        "sweep_report": selection.sweep_report(summary),
    }


def build_diagnostics(
    predictions: DataFrame,
    comparison: DataFrame,
    run_id: str | None,
    split: str = "test",
    cv_results: DataFrame | None = None,
    sweep: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Tables, plot data and notes; nothing is refitted or edited.

    The predictions are written once, because every table reads them.
    """
    if "income_decile" not in predictions.columns:
        predictions = metrics.income_decile(predictions)
    stored = settle(predictions)
    selected = metrics.selected_split(stored, split)
    by_decile = metrics.error_by_decile(stored)
    tables = {
        "residual_summary": metrics.residual_summary(stored),
        "error_by_income_decile": by_decile,
        "pairwise_error_comparison": metrics.pairwise_errors(stored),
        "metric_gaps": metrics.metric_gaps(comparison, run_id),
        "prediction_distribution": explore.histogram(selected, ["y_true", "y_pred"], 30, ["model"]),
        "residual_distribution": explore.histogram(selected, ["residual"], 30, ["model"]),
        "decile_curves": decile_curves(by_decile, split),
    }
    notes = []
    best = selection.best_model(comparison).first() if "validation_r2" in comparison.columns else None
    if best is None:
        notes.append("Skipped observed_vs_predicted: validation_r2 is missing.")
    else:
        tables["observed_vs_predicted"] = explore.observed_vs_predicted(selected, best["model"])
    if cv_results is None:
        notes.append("Skipped alpha curves: no cv_results.")
    else:
        for name in ("Ridge", "Lasso"):
            tables[f"{name.lower()}_alpha_curve"] = selection.alpha_curve(cv_results.filter(F.col("model") == name))
        if sweep:
            boosted = cv_results.filter(F.col("model") == "HistGradientBoostingRegressor")
            tables |= sweep_tables(boosted, sweep.get("sweep_type"), sweep.get("primary_param"), sweep.get("group_param"), run_id)
    listed = [(name, "generated") for name in tables] + [(note, "skipped") for note in notes]
    entries = F.array(*[F.struct(F.lit(n).alias("item"), F.lit(s).alias("status")) for n, s in listed])
    tables["notes"] = predictions.sparkSession.range(1).select(F.explode(entries).alias("e")).select("e.*")
    return tables
