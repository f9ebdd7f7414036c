"""One experiment from a dataset to an archived run, and studies made of them."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintil.contract import Contract
from quintil.functions.scalar import with_errors
from quintil.ml import linear, models
from quintil.operators import metrics, selection, splits
from quintil.operators.effects import apply_fixed_effects, apply_view
from quintil.plans.diagnostics import build_diagnostics
from quintil.sources.runs import RunRegistry
from quintil.session import settle

LINEAR = ("linear_regression", "ridge", "lasso", "elastic_net")


@dataclass
class Experiment:
    """What to run; the defaults follow the baseline."""

    experiment_id: str
    models: Mapping[str, Mapping[str, Sequence[object]]]
    folds: int = 3
    sample_n: int | None = None
    seed: int = 42
    categorical: Sequence[str] = ()
    view: Mapping[str, object] = field(default_factory=dict)
    fixed_effects: Sequence[Mapping[str, object]] = ()
    training_sample_n: int | None = 10
    mode: str = "full"
    sweep: Mapping[str, str] | None = None
    drop_first: bool = False
    diagnostics: bool = True
    contract: Contract = field(default_factory=Contract)


@dataclass
class RunResult:
    run_id: str
    comparison: DataFrame
    predictions: DataFrame
    cv_results: DataFrame
    coefficients: DataFrame | None
    features: list[str]
    facts: dict[str, object]
    tables: dict[str, DataFrame]


def predict_frame(df: DataFrame, y_pred, run_id: str, model: str, target: str) -> DataFrame:
    """Scored rows in the layout of the predictions table, without deciles."""
    return with_errors(
        df.select(F.lit(run_id).alias("run_id"), F.lit(model).alias("model"), "split", "row_id", F.col(target).alias("y_true"), y_pred.alias("y_pred"))
    )


def run_experiment(
    spec: Experiment, dataset: DataFrame, assignments: DataFrame | None, run_id: str, registry: RunRegistry | None = None
) -> RunResult:
    """Frame, view, effects, fits, predictions, diagnostics, archive.

    The prepared frame is written once, because every model reads it again. Without assignments the dataset already has
    its checked splits (``splits.checked_frame``).
    """
    spark, target = dataset.sparkSession, spec.contract.target
    joined, features = splits.prepare_frame(dataset, assignments, spec.sample_n, spec.folds, spec.seed, spec.contract)
    viewed, features, view_facts = apply_view(
        joined, features, spec.view.get("name"), spec.view.get("drop_columns") or (), spec.view.get("permute_group_values") or (), spec.contract
    )
    framed, features, effect_facts = apply_fixed_effects(viewed, features, spec.fixed_effects, spec.contract)
    categorical = [*spec.categorical, *[f["generated_column"] for f in effect_facts]]
    frame = settle(framed)
    splits.require_splits(frame)
    train, held = frame.filter(F.col("split") == "train"), frame.filter(F.col("split") != "train")
    drop_first = [f["generated_column"] for f in effect_facts if f["drop_first"]] if spec.drop_first else []

    products = None
    scored: list[DataFrame] = []
    cv_frames: list[DataFrame] = []
    coefficient_frames: list[DataFrame] = []
    paths: list[DataFrame] = []
    facts: list[tuple] = []
    for key, grid in spec.models.items():
        name = linear.MODEL_NAMES.get(key, key)
        if key in LINEAR:
            if products is None:
                products = linear.training_set(train, features, target, spec.folds, categorical)
            alphas = list(grid.get("alpha", (1.0,)))
            result = linear.grid_search(products, key, alphas, grid.get("l1_ratio", (1.0,)), drop_first)
            scored.append(predict_frame(result.fit.transform(held), F.col("y_pred"), run_id, name, target))
            cv_frames.append(linear.cv_frame(spark, result))
            coefficient_frames.append(linear.coefficient_frame(spark, result.fit, name, run_id))
            if key in ("ridge", "lasso"):
                paths.append(linear.regularization_path(spark, products, key, alphas))
        else:
            result = models.grid_search(train, features, target, key, grid, spec.folds, categorical, seed=spec.seed)
            scored.append(predict_frame(result.fit.transform(held), F.col("y_pred"), run_id, name, target))
            cv_frames.append(models.search_frame(spark, result, name))
        facts.append((name, json.dumps(result.best_params, sort_keys=True), len(features), result.best_score, result.best_std, result.seconds))

    if products is not None:
        products.close()

    predictions = scored[0]
    for other in scored[1:]:
        predictions = predictions.unionByName(other)
    predictions = settle(metrics.income_decile(settle(predictions)))
    schema = "model string, best_params string, feature_count int, cv_r2_mean double, cv_r2_std double, fit_time_seconds double"
    comparison = settle(spark.createDataFrame(facts, schema).join(metrics.model_comparison(predictions), "model"))
    metrics.require_feature_count_consistency(comparison)
    cv_results = _union(cv_frames)
    coefficients = selection.coefficient_table(_union(coefficient_frames)) if coefficient_frames else None
    tables = {}
    if spec.diagnostics:
        tables = build_diagnostics(predictions, comparison, run_id, cv_results=cv_results, sweep=dict(spec.sweep) if spec.sweep else None)
    tables["metrics_long"] = metrics.metrics_long(comparison, run_id)
    if coefficients is not None:
        tables["coefficients"] = coefficients
        if effect_facts:
            tables["fixed_effect_coefficients"] = selection.effect_coefficients(coefficients, effect_facts)
    if paths:
        tables["regularization_path"] = _union(paths)
    sample = splits.training_sample(train, features, target, spec.training_sample_n, spec.seed, spec.contract)
    if sample is not None:
        tables["training_sample"] = sample
    run_facts = {
        "experiment_id": spec.experiment_id,
        "mode": spec.mode,
        "rows_used": frame.count(),
        "feature_count": len(features),
        "feature_view": view_facts,
        "fixed_effects_used": effect_facts,
    }
    result = RunResult(run_id, comparison, predictions, cv_results, coefficients, features, run_facts, tables)
    if registry is not None:
        archive(registry, result)
    return result


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def manifest_frame(result: RunResult) -> DataFrame:
    """The run's manifest as one row."""
    spark = result.comparison.sparkSession
    facts = result.facts
    row = (
        facts["experiment_id"],
        facts["mode"],
        facts["rows_used"],
        facts["feature_count"],
        result.features,
        {k: facts["feature_view"][k] for k in ("name", "drop_columns", "permuted_columns")},
        [
            {k: f[k] for k in ("fe_name", "source_columns", "generated_column", "n_levels", "max_levels", "drop_first")}
            for f in facts["fixed_effects_used"]
        ],
    )
    schema = """experiment_id string, mode string, rows_used long, feature_count long, feature_columns array<string>,
    feature_view struct<name: string, drop_columns: array<string>, permuted_columns: array<string>>,
    fixed_effects_used array<struct<fe_name: string, source_columns: array<string>, generated_column: string,
      n_levels: int, max_levels: int, drop_first: boolean>>"""
    return spark.createDataFrame([row], schema).withColumn("created_at", F.current_timestamp())


def archive(registry: RunRegistry, result: RunResult) -> None:
    tables = {
        "metrics": result.comparison,
        "predictions": result.predictions,
        "cv_results": result.cv_results,
        "diagnostics": metrics.run_residual_summary(result.predictions),
        "manifest": manifest_frame(result),
    }
    if result.coefficients is not None:
        tables["coefficients"] = result.coefficients
    if "training_sample" in result.tables:
        tables["samples"] = result.tables["training_sample"]
    registry.record(result.run_id, tables)


def registry_manifests(registry: RunRegistry, run_ids: Sequence[str] | None = None) -> DataFrame:
    """Manifests of archived runs in the layout that the comparison reads."""
    directory = F.concat(F.lit(registry.root + "/"), F.col("run_id"))
    return registry.read("manifest", run_ids).select(
        "run_id", "experiment_id", "mode", "rows_used", "feature_count", directory.alias("run_dir"),
        F.lit(None).cast("string").alias("canonical_run_dir"), "feature_view", "fixed_effects_used", directory.alias("directory"),
    )


GEO_COLUMNS = ("AGLOMERADO", "Region")
GEO_RANKS = ("AGLO_rk", "Reg_rk")
GEO_VARIANTS: dict[str, dict[str, object]] = {
    "with_geo_ranks": {"name": "with_geo_ranks"},
    "clean_geo": {"name": "clean_geo", "drop_columns": list(GEO_RANKS)},
    "no_geo": {"name": "no_geo", "drop_columns": [*GEO_COLUMNS, *GEO_RANKS]},
    "shuffled_geo_ranks": {
        "name": "shuffled_geo_ranks",
        "permute_group_values": [
            {"column": "AGLO_rk", "group_by": "AGLOMERADO", "random_state": 42},
            {"column": "Reg_rk", "group_by": "Region", "random_state": 42},
        ],
    },
}


def geo_probe(spec: Experiment, dataset: DataFrame, assignments: DataFrame, material: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """The four geography variants and how to read their scores.

    Returns (variant scores, reading); ``material`` is the R2 difference that
    counts as one.
    """
    joined = settle(splits.checked_frame(dataset, assignments))
    scores = []
    for variant, view in GEO_VARIANTS.items():
        run = run_experiment(
            Experiment(**{**spec.__dict__, "experiment_id": f"{spec.experiment_id}_{variant}", "view": view, "diagnostics": False}), joined, None, variant
        )
        scores.append(run.comparison.select(F.lit(variant).alias("variant"), "model", "feature_count", "cv_r2_mean", "test_r2", "validation_r2"))
    table = settle(_union(scores))
    wide = table.groupBy("model").agg(
        *[F.max(F.when(F.col("variant") == v, F.col("validation_r2"))).alias(v) for v in GEO_VARIANTS]
    )
    ranks_help = F.col("with_geo_ranks") - F.col("clean_geo") > material
    shuffled_like_clean = F.abs(F.col("shuffled_geo_ranks") - F.col("clean_geo")) <= material
    reading = (
        F.when(ranks_help & shuffled_like_clean, "ranks carry target-derived signal")
        .when(ranks_help, "suspect a bug or a spurious effect")
        .otherwise("ranks are unnecessary")
    )
    geography = F.when(F.col("clean_geo") - F.col("no_geo") > material, "geography matters").otherwise("geography adds little")
    return table, wide.select("model", *GEO_VARIANTS, reading.alias("rank_reading"), geography.alias("geo_reading"))


# Designs of the fixed-effect study, as fixed values.
FIXED_EFFECTS: dict[str, dict[str, object]] = {
    "region_fe": {"columns": ["Region"], "max_levels": 20, "drop": [*GEO_RANKS, "AGLOMERADO"]},
    "aglo_fe": {"columns": ["AGLOMERADO"], "max_levels": 100, "drop": [*GEO_RANKS, "Region"]},
    "year_fe": {"columns": ["ANO4"], "max_levels": 10, "drop": []},
    "quarter_fe": {"columns": ["TRIMESTRE"], "max_levels": 8, "drop": []},
    "aglo_year_fe": {"columns": ["AGLOMERADO", "ANO4"], "max_levels": 500, "drop": [*GEO_RANKS, "Region"]},
}


def fixed_effect_study(
    spec: Experiment, dataset: DataFrame, assignments: DataFrame, effects: Sequence[str] = tuple(FIXED_EFFECTS)
) -> tuple[DataFrame, DataFrame]:
    """Linear models with one generated effect each: (scores, effect coefficients).

    The dataset is checked, joined with its splits and written once for all of them.
    """
    joined = settle(splits.checked_frame(dataset, assignments))
    scores, coefficients = [], []
    for name in effects:
        design = FIXED_EFFECTS[name]
        effect = {"name": name, "columns": design["columns"], "max_levels": design["max_levels"], "drop_first": True}
        view = {"name": f"{name}_clean", "drop_columns": design["drop"]}
        run = run_experiment(
            Experiment(**{**spec.__dict__, "experiment_id": f"{spec.experiment_id}_{name}", "view": view, "fixed_effects": [effect], "diagnostics": False}),
            joined, None, name,
        )
        scores.append(run.comparison.withColumn("effect", F.lit(name)))
        coefficients.append(run.tables["fixed_effect_coefficients"])
    return _union(scores), _union(coefficients)
