"""Queries on stored predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quintil.catalog.base import PREDICTIONS, predictions, query, raw_predictions, tidy, tidy_sql
from quintil.functions.scalar import with_errors
from quintil.operators import explore, metrics, selection

G = "run_id, model, split"


@query("f1_income_decile", f"{PREDICTIONS} SELECT model, row_id, income_decile FROM predictions")
def f1(spark, sf_dir):
    return predictions(spark, sf_dir).select("model", "row_id", "income_decile")


@query("j19_predict_frame", tidy_sql(f"{PREDICTIONS} SELECT * FROM predictions", "y_true y_pred residual abs_error squared_error"))
def j19(spark, sf_dir):
    return tidy(predictions(spark, sf_dir))


@query("h2_union_predictions", f"{PREDICTIONS} SELECT model, split, count(*) AS n FROM predictions GROUP BY model, split")
def h2(spark, sf_dir):
    df = predictions(spark, sf_dir)
    parts = [df.filter(F.col("split") == s) for s in ("test", "validation")]
    return parts[0].unionByName(parts[1]).groupBy("model", "split").agg(F.count(F.lit(1)).alias("n"))


@query("b11_selected_split", f"{PREDICTIONS} SELECT model, row_id FROM predictions WHERE split = 'test'")
def b11(spark, sf_dir):
    return metrics.selected_split(predictions(spark, sf_dir), "test").select("model", "row_id")


RESIDUAL = f"""SELECT {G}, count(*) AS n, avg(residual) AS residual_mean, stddev_samp(residual) AS residual_std,
  quantile_cont(residual, 0.5) AS residual_median, quantile_cont(residual, 0.05) AS residual_p05, quantile_cont(residual, 0.25) AS residual_p25,
  quantile_cont(residual, 0.75) AS residual_p75, quantile_cont(residual, 0.95) AS residual_p95,
  avg(abs_error) AS mae, avg(squared_error) AS mse, sqrt(avg(squared_error)) AS rmse,
  1 - avg(squared_error) / var_pop(y_true) AS r2, avg(y_true) AS y_true_mean, stddev_samp(y_true) AS y_true_std,
  avg(y_pred) AS y_pred_mean, stddev_samp(y_pred) AS y_pred_std FROM predictions GROUP BY {G}"""
RESIDUAL_COLUMNS = ("residual_mean residual_std residual_median residual_p05 residual_p25 residual_p75 residual_p95 "
                    "mae mse rmse r2 y_true_mean y_true_std y_pred_mean y_pred_std")


@query("e3_residual_summary", tidy_sql(f"{PREDICTIONS} {RESIDUAL}", RESIDUAL_COLUMNS))
def e3(spark, sf_dir):
    return tidy(metrics.residual_summary(predictions(spark, sf_dir)))


DECILES = f"""SELECT {G}, income_decile, count(*) AS n, min(y_true) AS y_true_min, max(y_true) AS y_true_max, avg(y_true) AS y_true_mean,
  avg(abs_error) AS mae, avg(squared_error) AS mse, sqrt(avg(squared_error)) AS rmse, avg(residual) AS residual_mean,
  quantile_cont(residual, 0.5) AS residual_median FROM predictions GROUP BY {G}, income_decile"""


@query("e4_error_by_decile", tidy_sql(f"{PREDICTIONS} {DECILES}", "y_true_min y_true_max y_true_mean mae mse rmse residual_mean residual_median"))
def e4(spark, sf_dir):
    return tidy(metrics.error_by_decile(predictions(spark, sf_dir)))


@query("k5_decile_curves", tidy_sql(f"{PREDICTIONS} SELECT model, income_decile, mae, residual_mean FROM ({DECILES}) WHERE split = 'test'", "mae residual_mean"))
def k5(spark, sf_dir):
    from quintil.plans.diagnostics import decile_curves

    return tidy(decile_curves(metrics.error_by_decile(predictions(spark, sf_dir)), "test"))


@query("e5_run_residual_summary", tidy_sql(f"""{PREDICTIONS} SELECT {G}, count(*) AS row_count, avg(residual) AS residual_mean, stddev_samp(residual) AS residual_std,
  min(residual) AS residual_min, max(residual) AS residual_max, avg(abs_error) AS abs_error_mean, avg(squared_error) AS squared_error_mean
  FROM predictions GROUP BY {G}""", "residual_mean residual_std residual_min residual_max abs_error_mean squared_error_mean"))
def e5(spark, sf_dir):
    return tidy(metrics.run_residual_summary(predictions(spark, sf_dir)))


@query("e6_run_decile_summary", tidy_sql(f"""{PREDICTIONS} SELECT {G}, income_decile, count(*) AS row_count, avg(y_true) AS y_true_mean, avg(y_pred) AS y_pred_mean,
  avg(residual) AS residual_mean, avg(abs_error) AS abs_error_mean, avg(squared_error) AS squared_error_mean
  FROM predictions GROUP BY {G}, income_decile""", "y_true_mean y_pred_mean residual_mean abs_error_mean squared_error_mean"))
def e6(spark, sf_dir):
    return tidy(metrics.run_decile_summary(predictions(spark, sf_dir)))


DISTRIBUTION = ", ".join(
    f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, min({c}) AS {c}_min, quantile_cont({c}, 0.25) AS {c}_p25, "
    f"quantile_cont({c}, 0.5) AS {c}_median, quantile_cont({c}, 0.75) AS {c}_p75, max({c}) AS {c}_max" for c in ("y_true", "y_pred"))


@query("e7_prediction_distribution", tidy_sql(
    f"{PREDICTIONS} SELECT {G}, count(*) AS row_count, {DISTRIBUTION} FROM predictions GROUP BY {G}",
    " ".join(f"{c}_{s}" for c in ("y_true", "y_pred") for s in ("mean", "std", "min", "p25", "median", "p75", "max"))))
def e7(spark, sf_dir):
    return tidy(metrics.prediction_distribution(predictions(spark, sf_dir)))


@query("e8_regression_metrics", tidy_sql(f"""{PREDICTIONS} SELECT model, split, 1 - sum(squared_error) / (var_pop(y_true) * count(*)) AS r2,
  avg(abs_error) AS mae, avg(squared_error) AS mse FROM with_errors GROUP BY model, split""", "r2 mae mse"))
def e8(spark, sf_dir):
    return tidy(metrics.regression_metrics(raw_predictions(spark, sf_dir).withColumn("y_pred", F.round("y_pred", 9))))


PAIRS = "FROM with_errors a JOIN with_errors b ON a.run_id = b.run_id AND a.split = b.split AND a.row_id = b.row_id AND a.model < b.model"


def errors(spark, sf_dir):
    return with_errors(raw_predictions(spark, sf_dir).withColumn("y_pred", F.round("y_pred", 9)))


@query("d5_pairwise_join", tidy_sql(f"""{PREDICTIONS} SELECT a.run_id, a.split, a.row_id, a.model AS model_a, b.model AS model_b,
  a.abs_error AS a, b.abs_error AS b {PAIRS}""", "a b"))
def d5(spark, sf_dir):
    return tidy(metrics.paired_errors(errors(spark, sf_dir)))


@query("e9_pairwise_errors", tidy_sql(f"""{PREDICTIONS} SELECT a.run_id, a.split, a.model AS model_a, b.model AS model_b, count(*) AS n_common_rows,
  avg(CAST(a.abs_error < b.abs_error AS INT)) AS share_rows_a_better, avg(CAST(b.abs_error < a.abs_error AS INT)) AS share_rows_b_better,
  avg(CAST(a.abs_error = b.abs_error AS INT)) AS share_rows_tied, avg(a.abs_error) AS mean_abs_error_a, avg(b.abs_error) AS mean_abs_error_b,
  avg(a.abs_error) - avg(b.abs_error) AS mean_abs_error_difference_a_minus_b {PAIRS} GROUP BY ALL""",
  "share_rows_a_better share_rows_b_better share_rows_tied mean_abs_error_a mean_abs_error_b mean_abs_error_difference_a_minus_b"))
def e9(spark, sf_dir):
    return tidy(metrics.pairwise_errors(errors(spark, sf_dir)))


M = f"""{PREDICTIONS}, s AS (SELECT model, split, 1 - avg(squared_error) / var_pop(y_true) AS r2, avg(abs_error) AS mae, avg(squared_error) AS mse FROM with_errors GROUP BY model, split),
  comparison AS (SELECT t.model, t.r2 AS test_r2, t.mae AS test_mae, t.mse AS test_mse, v.r2 AS validation_r2, v.mae AS validation_mae, v.mse AS validation_mse
    FROM s t JOIN s v ON t.model = v.model AND t.split = 'test' AND v.split = 'validation')"""
NAMES = ("test_r2", "test_mae", "test_mse", "validation_r2", "validation_mae", "validation_mse")


def comparison(spark, sf_dir):
    return metrics.model_comparison(errors(spark, sf_dir))


@query("e10_metric_gaps", tidy_sql(f"""{M} SELECT 'run_a' AS run_id, model, metric, test_value, validation_value, validation_value - test_value AS validation_minus_test FROM (
  {" UNION ALL ".join(f"SELECT model, '{m}' AS metric, test_{m} AS test_value, validation_{m} AS validation_value FROM comparison" for m in ("mae", "mse", "r2"))})""",
  "test_value validation_value validation_minus_test"))
def e10(spark, sf_dir):
    return tidy(metrics.metric_gaps(comparison(spark, sf_dir), "run_a"))


@query("k1_metrics_long", tidy_sql(
    f"""{M} SELECT 'run_a' AS run_id, model, metric, value FROM ({" UNION ALL ".join(f"SELECT model, '{m}' AS metric, {m} AS value FROM comparison" for m in NAMES)})""", "value"))
def k1(spark, sf_dir):
    return tidy(metrics.metrics_long(comparison(spark, sf_dir), "run_a"))


@query("g2_best_model", f"{M} SELECT model FROM comparison ORDER BY validation_r2 DESC, model LIMIT 1")
def g2(spark, sf_dir):
    return selection.best_model(comparison(spark, sf_dir)).select("model")


@query("e32_feature_count_consistency", f"{M} SELECT count(*) AS models, 1 AS feature_counts, true AS consistent FROM comparison")
def e32(spark, sf_dir):
    return metrics.feature_count_consistency(comparison(spark, sf_dir).withColumn("feature_count", F.lit(6)))


@query("e28_model_summary", tidy_sql(f"""{PREDICTIONS} SELECT model, 1 - avg(squared_error) / var_pop(y_true) AS r2, avg(abs_error) AS mae,
  var_pop(y_pred) AS var_pred, avg(-residual) AS mean_error, var_pop(residual) AS var_error FROM with_errors GROUP BY model""",
  "r2 mae var_pred mean_error var_error"))
def e28(spark, sf_dir):
    return tidy(metrics.model_summary(errors(spark, sf_dir)))


SUBGROUP = " UNION ALL ".join(
    f"""SELECT model, '{d}' AS dimension, {e} AS "group", count(*) AS n, avg(squared_error) AS mse, sqrt(avg(squared_error)) AS rmse, avg(abs_error) AS mae,
  avg(-residual) AS error, var_samp(y_true) AS var_real, var_pop(y_pred) AS var_pred, var_samp(residual) AS error_var,
  CASE WHEN var_pop(y_true) > 0 THEN 1 - avg(squared_error) / var_pop(y_true) END AS r2 FROM with_errors WHERE {e} IS NOT NULL GROUP BY model, {e}"""
    for d, e in (("Region", "Region"), ("Trimestre", "CAST(TRIMESTRE AS VARCHAR)"),
                 ("Categoria", "CASE WHEN CAT_OCUP <> '5-LOW' THEN CAT_OCUP END")))
SUB_COLUMNS = "mse rmse mae error var_real var_pred error_var r2"


def subgroups(spark, sf_dir):
    return metrics.subgroup_performance(
        errors(spark, sf_dir),
        {
            "Region": F.col("Region"),
            "Trimestre": F.col("TRIMESTRE"),
            "Categoria": F.when(F.col("CAT_OCUP") != "5-LOW", F.col("CAT_OCUP")),
        },
    )


@query("e26_subgroup_performance", tidy_sql(f"{PREDICTIONS} {SUBGROUP}", SUB_COLUMNS))
def e26(spark, sf_dir):
    return tidy(subgroups(spark, sf_dir))


@query("e27_bias_ci", tidy_sql(f"""{PREDICTIONS} SELECT model, dimension, "group", ci95, error - ci95 AS ci_low, error + ci95 AS ci_high,
  error - ci95 > 0 OR error + ci95 < 0 AS significant, var_pred / nullif(var_real, 0) AS var_ratio
  FROM (SELECT *, 1.96 * sqrt(error_var) / sqrt(n) AS ci95 FROM ({SUBGROUP}))""", "ci95 ci_low ci_high var_ratio"))
def e27(spark, sf_dir):
    return tidy(
        metrics.bias_ci(subgroups(spark, sf_dir)).select(
            "model", "dimension", "group", "ci95", "ci_low", "ci_high", "significant", "var_ratio"
        )
    )


HIST = """SELECT model, variable, bin, lo + bin * w AS bin_start, count(*) AS n, count(*) / (total * w) AS density FROM (
  SELECT model, variable, total, lo, w, CAST(least({last}, floor((x - lo) / w)) AS INT) AS bin FROM (
    SELECT model, variable, x, count(*) OVER g AS total, CASE WHEN max(x) OVER g = min(x) OVER g THEN min(x) OVER g - 0.5 ELSE min(x) OVER g END AS lo,
      CASE WHEN max(x) OVER g = min(x) OVER g THEN 1.0 ELSE max(x) OVER g - min(x) OVER g END / {bins} AS w
    FROM ({source}) WINDOW g AS (PARTITION BY model, variable))) GROUP BY model, variable, bin, lo, w, total"""


@query("e33_histogram", tidy_sql(PREDICTIONS + " " + HIST.format(last=29, bins=30, source="""SELECT model, 'y_true' AS variable, y_true AS x FROM with_errors WHERE split = 'test'
  UNION ALL SELECT model, 'y_pred', y_pred FROM with_errors WHERE split = 'test' UNION ALL SELECT model, 'residual', residual FROM with_errors WHERE split = 'test'"""), "bin_start density"))
def e33(spark, sf_dir):
    test = errors(spark, sf_dir).filter(F.col("split") == "test")
    return tidy(explore.histogram(test, ["y_true", "y_pred", "residual"], 30, ["model"]))


@query("e34_density_2d", f"""{PREDICTIONS}, t AS (SELECT y_true AS x, y_pred AS y FROM with_errors WHERE split = 'test' AND model = 'Univariate'),
  b AS (SELECT min(x) AS x0, (max(x) - min(x)) / 45 AS xw, min(y) AS y0, (max(y) - min(y)) / 45 AS yw FROM t)
  SELECT CAST(least(44, floor((x - x0) / xw)) AS INT) AS x_cell, CAST(least(44, floor((y - y0) / yw)) AS INT) AS y_cell, count(*) AS n FROM t, b GROUP BY ALL""")
def e34(spark, sf_dir):
    test = errors(spark, sf_dir).filter((F.col("split") == "test") & (F.col("model") == "Univariate"))
    return explore.density_2d(test)


@query("k4_build_diagnostics", tidy_sql(f"""{M}, rs AS ({RESIDUAL}), ed AS ({DECILES})
  SELECT 'residual_summary' AS artifact, count(*) AS n_rows, sum(n)::BIGINT AS rows_covered, avg(mae) AS mean_mae FROM rs
  UNION ALL SELECT 'error_by_income_decile', count(*), sum(n)::BIGINT, avg(mae) FROM ed
  UNION ALL SELECT 'pairwise_error_comparison', count(*), sum(n)::BIGINT, avg(m) FROM (SELECT count(*) AS n, avg(a.abs_error) AS m {PAIRS} GROUP BY a.run_id, a.split, a.model, b.model)
  UNION ALL SELECT 'metric_gaps', 6, 0, NULL""", "mean_mae"))
def k4(spark, sf_dir):
    from quintil.plans.diagnostics import build_diagnostics

    stored = predictions(spark, sf_dir)
    tables = build_diagnostics(stored, comparison(spark, sf_dir), "run_a")
    size = {"residual_summary": ("n", "mae"), "error_by_income_decile": ("n", "mae"),
            "pairwise_error_comparison": ("n_common_rows", "mean_abs_error_a"), "metric_gaps": (None, None)}
    out = None
    for name, (n, mae) in size.items():
        row = tables[name].agg(
            F.count(F.lit(1)).alias("n_rows"),
            (F.sum(n) if n else F.lit(0)).cast("long").alias("rows_covered"),
            (F.avg(mae) if mae else F.lit(None).cast("double")).alias("mean_mae"),
        ).select(F.lit(name).alias("artifact"), "*")
        out = row if out is None else out.unionByName(row)
    return tidy(out)
