"""Error metrics, deciles and the diagnostics of stored predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quintil.functions.quantiles import exact_percentiles, percentile_columns
from quintil.functions.scalar import safe_ratio, with_errors
from quintil.session import side_table

PREDICTION_COLUMNS = (
    "run_id", "model", "split", "row_id", "y_true", "y_pred", "residual", "abs_error", "squared_error",
)
GROUP = ("run_id", "model", "split")


def r2(truth: str = "y_true", prediction: str = "y_pred") -> Column:
    """Coefficient of determination as an aggregate, NULL for a constant target."""
    error = F.col(truth) - F.col(prediction)
    total = F.var_pop(truth)
    return F.when(total > 0, 1.0 - F.avg(error * error) / total)


def error_metrics(truth: str = "y_true", prediction: str = "y_pred") -> list[Column]:
    error = F.col(truth) - F.col(prediction)
    return [
        r2(truth, prediction).alias("r2"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
    ]


def regression_metrics(df: DataFrame, keys: Sequence[str] = ("model", "split")) -> DataFrame:
    return df.groupBy(*keys).agg(*error_metrics())


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two grouped tables on keys that may be NULL."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"__{key}"])
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def income_decile(df: DataFrame, truth: str = "y_true", keys: Sequence[str] = GROUP) -> DataFrame:
    """Quantile bins 1..10 of the target per group; repeated edges merge.

    A group whose values are all equal has a single edge and gets NULL.
    """
    keys = list(keys)
    edges = exact_percentiles(df, [truth], [i / 10 for i in range(11)], keys)
    edges = side_table(edges.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.array_distinct("q").alias("__e")))
    condition = F.lit(True)
    for key in keys:
        condition = condition & df[key].eqNullSafe(edges[f"__k_{key}"])
    joined = df.join(edges, condition, "left")
    below = F.size(F.filter("__e", lambda e: e < F.col(truth)))
    decile = F.when((F.size("__e") >= 2) & F.col(truth).isNotNull(), F.greatest(F.lit(1), below))
    return joined.select(*df.columns, decile.cast("int").alias("income_decile"))


def predictions_table(df: DataFrame) -> DataFrame:
    """Errors and deciles added to (run_id, model, split, row_id, y_true, y_pred)."""
    return income_decile(with_errors(df))


def residual_summary(predictions: DataFrame) -> DataFrame:
    """Moments, percentiles and metrics of the residuals per run, model and split."""
    moments = predictions.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("residual").alias("residual_mean"),
        F.stddev_samp("residual").alias("residual_std"),
        F.avg("abs_error").alias("mae"),
        F.avg("squared_error").alias("mse"),
        F.sqrt(F.avg("squared_error")).alias("rmse"),
        r2().alias("r2"),
        F.avg("y_true").alias("y_true_mean"),
        F.stddev_samp("y_true").alias("y_true_std"),
        F.avg("y_pred").alias("y_pred_mean"),
        F.stddev_samp("y_pred").alias("y_pred_std"),
    )
    points = {"residual_median": 0.5, "residual_p05": 0.05, "residual_p25": 0.25, "residual_p75": 0.75, "residual_p95": 0.95}
    return join_null_safe(moments, percentile_columns(predictions, GROUP, {"residual": points}), GROUP)


def error_by_decile(predictions: DataFrame) -> DataFrame:
    keys = [*GROUP, "income_decile"]
    moments = predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("y_true").alias("y_true_min"),
        F.max("y_true").alias("y_true_max"),
        F.avg("y_true").alias("y_true_mean"),
        F.avg("abs_error").alias("mae"),
        F.avg("squared_error").alias("mse"),
        F.sqrt(F.avg("squared_error")).alias("rmse"),
        F.avg("residual").alias("residual_mean"),
    )
    return join_null_safe(moments, percentile_columns(predictions, keys, {"residual": {"residual_median": 0.5}}), keys)


def run_residual_summary(predictions: DataFrame) -> DataFrame:
    """The shorter table a run writes by itself."""
    return predictions.groupBy(*GROUP).agg(
        F.count("row_id").alias("row_count"),
        F.avg("residual").alias("residual_mean"),
        F.stddev_samp("residual").alias("residual_std"),
        F.min("residual").alias("residual_min"),
        F.max("residual").alias("residual_max"),
        F.avg("abs_error").alias("abs_error_mean"),
        F.avg("squared_error").alias("squared_error_mean"),
    )


def run_decile_summary(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy(*GROUP, "income_decile").agg(
        F.count("row_id").alias("row_count"),
        F.avg("y_true").alias("y_true_mean"),
        F.avg("y_pred").alias("y_pred_mean"),
        F.avg("residual").alias("residual_mean"),
        F.avg("abs_error").alias("abs_error_mean"),
        F.avg("squared_error").alias("squared_error_mean"),
    )


def prediction_distribution(predictions: DataFrame) -> DataFrame:
    """Mean, spread and quartiles of observed and predicted values."""
    moments, points = [F.count("row_id").alias("row_count")], {}
    for c in ("y_true", "y_pred"):
        moments += [
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_samp(c).alias(f"{c}_std"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
        points[c] = {f"{c}_p25": 0.25, f"{c}_median": 0.5, f"{c}_p75": 0.75}
    return join_null_safe(predictions.groupBy(*GROUP).agg(*moments), percentile_columns(predictions, GROUP, points), GROUP)


def paired_errors(predictions: DataFrame) -> DataFrame:
    """Absolute errors of every model pair on common rows, names in order.

    One shuffle by row gathers a row's models (as many as there are models),
    and pairs are formed inside it. A model that repeats a row fails the job.
    """
    keys = ["run_id", "split", "row_id"]
    message = F.concat(F.lit("Duplicate prediction for row "), F.col("row_id").cast("string"))
    per_model = (
        predictions.filter(F.col("model").isNotNull())
        .groupBy(*keys, "model")
        .agg(F.max("abs_error").alias("e"), F.count(F.lit(1)).alias("c"))
        .withColumn("e", F.when(F.col("c") > 1, F.raise_error(message).cast("double")).otherwise(F.col("e")))
    )
    by_row = per_model.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("model", "e"))).alias("m"))
    pairs = F.flatten(
        F.transform(
            "m",
            lambda a, i: F.transform(
                F.slice("m", i + 2, F.size("m")),
                lambda b: F.struct(
                    a["model"].alias("model_a"), b["model"].alias("model_b"), a["e"].alias("a"), b["e"].alias("b")
                ),
            ),
        )
    )
    return by_row.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def pairwise_errors(predictions: DataFrame) -> DataFrame:
    def share(condition: Column) -> Column:
        return F.avg(condition.cast("double"))

    a, b = F.col("a"), F.col("b")
    return paired_errors(predictions).groupBy("run_id", "split", "model_a", "model_b").agg(
        F.count(F.lit(1)).alias("n_common_rows"),
        share(a < b).alias("share_rows_a_better"),
        share(b < a).alias("share_rows_b_better"),
        share(a == b).alias("share_rows_tied"),
        F.avg(a).alias("mean_abs_error_a"),
        F.avg(b).alias("mean_abs_error_b"),
        (F.avg(a) - F.avg(b)).alias("mean_abs_error_difference_a_minus_b"),
    )


def metric_gaps(comparison: DataFrame, run_id: str | None = None) -> DataFrame:
    """validation - test for every metric that both splits report."""
    tested = {c.removeprefix("test_") for c in comparison.columns if c.startswith("test_")}
    common = sorted(m for m in tested if f"validation_{m}" in comparison.columns)
    entries = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"test_{m}").cast("double").alias("test_value"),
                F.col(f"validation_{m}").cast("double").alias("validation_value"),
            )
            for m in common
        ]
    )
    return comparison.select(F.lit(run_id).alias("run_id"), "model", F.explode(entries).alias("e")).select(
        "run_id", "model", "e.*", (F.col("e.validation_value") - F.col("e.test_value")).alias("validation_minus_test")
    )


def metrics_long(comparison: DataFrame, run_id: str) -> DataFrame:
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    columns = [c for c, t in comparison.dtypes if c not in ("model", "best_params") and t in numeric]
    typed = comparison.select("model", *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(["model"], columns, "metric", "value").select(F.lit(run_id).alias("run_id"), "model", "metric", "value")


def model_comparison(predictions: DataFrame) -> DataFrame:
    """Test and validation metrics side by side, one row per model."""
    wide = []
    for split in ("test", "validation"):
        here = F.col("split") == split
        error = F.when(here, F.col("y_true") - F.col("y_pred"))
        total = F.var_pop(F.when(here, F.col("y_true")))
        wide += [
            F.when(total > 0, 1.0 - F.avg(error * error) / total).alias(f"{split}_r2"),
            F.avg(F.abs(error)).alias(f"{split}_mae"),
            F.avg(error * error).alias(f"{split}_mse"),
        ]
    return predictions.groupBy("model").agg(*wide)


def selected_split(predictions: DataFrame, split: str) -> DataFrame:
    """Rows of one split; an unknown split fails and names the available ones."""
    selected = predictions.filter(F.col("split") == split)
    if selected.isEmpty():
        available = sorted(r[0] for r in predictions.select("split").distinct().collect() if r[0] is not None)
        raise ValueError(f"Split {split!r} has no rows here. Available splits: {available}")
    return selected


def model_summary(predictions: DataFrame) -> DataFrame:
    """R2, MAE and the population variances of predictions and errors per model."""
    error = F.col("y_pred") - F.col("y_true")
    return predictions.groupBy("model").agg(
        r2().alias("r2"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop("y_pred").alias("var_pred"),
        F.avg(error).alias("mean_error"),
        F.var_pop(error).alias("var_error"),
    )


def subgroup_performance(predictions: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Metrics per model, dimension and group.

    ``dimensions`` maps a dimension name to its group column; rows with a NULL
    group are left out of that dimension. Variances are sample variances except
    that of the predictions.
    """
    entries = F.array(
        *[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("group")) for n, c in dimensions.items()]
    )
    error = F.col("y_pred") - F.col("y_true")
    mse = F.avg(error * error)
    return (
        predictions.select("model", "y_true", "y_pred", F.explode(entries).alias("__d"))
        .filter(F.col("__d.group").isNotNull())
        .groupBy("model", F.col("__d.dimension").alias("dimension"), F.col("__d.group").alias("group"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            mse.alias("mse"),
            F.sqrt(mse).alias("rmse"),
            F.avg(F.abs(error)).alias("mae"),
            F.avg(error).alias("error"),
            F.var_samp("y_true").alias("var_real"),
            F.var_pop("y_pred").alias("var_pred"),
            F.var_samp(error).alias("error_var"),
            r2().alias("r2"),
        )
    )


def bias_ci(subgroups: DataFrame) -> DataFrame:
    """95 % interval of the mean error, its significance and the variance ratio."""
    half = 1.96 * F.sqrt("error_var") / F.sqrt("n")
    return subgroups.select(
        "*",
        half.alias("ci95"),
        (F.col("error") - half).alias("ci_low"),
        (F.col("error") + half).alias("ci_high"),
        ((F.col("error") - half > 0) | (F.col("error") + half < 0)).alias("significant"),
        safe_ratio("var_pred", "var_real").alias("var_ratio"),
    )


def feature_count_consistency(comparison: DataFrame) -> DataFrame:
    """One row: models, distinct feature counts (NULL counted) and whether they agree."""
    distinct = F.count_distinct(F.coalesce(F.col("feature_count").cast("string"), F.lit("<NA>")))
    return comparison.agg(F.count(F.lit(1)).alias("models"), distinct.alias("feature_counts")).withColumn(
        "consistent", (F.col("models") > 0) & (F.col("feature_counts") == 1)
    )


def require_feature_count_consistency(comparison: DataFrame) -> None:
    if not feature_count_consistency(comparison).first()["consistent"]:
        raise ValueError("All models of a run must report the same feature_count.")


