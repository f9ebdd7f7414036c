"""Models on one column whose fit has a closed form, so that SQL can state it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quintil.catalog.base import JOINED, people, query, split_people, tidy, tidy_sql
from quintil.catalog.models import TARGET, TRAIN, train_rows
from quintil.ml import models
from quintil.operators import splits

HALF = "CASE WHEN TRIMESTRE > 2 THEN 1 ELSE 0 END"
LABEL = "CASE WHEN X1 > 4 THEN 1 ELSE 0 END"
ALPHAS = (1.0, 100.0, 1000.0, 5000.0)


def halves(df):
    """A binary feature and a binary label."""
    return df.withColumns({"half": (F.col("TRIMESTRE") > 2).cast("int"), "label": (F.col("X1") > 4).cast("int")})


def by_half(df, *columns):
    return tidy(df.groupBy("half").agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("n")))


# One tree of one split predicts the two group means, a class share for a label.
@query("j9_forest_one_tree", tidy_sql(f"{TRAIN} SELECT {HALF} AS half, avg({TARGET}) AS y_pred, count(*) AS n FROM train GROUP BY half", "y_pred"))
def j9_one_tree(spark, sf_dir):
    rows = halves(train_rows(spark, sf_dir))
    return by_half(models.fit_model(rows, ["half"], TARGET, "random_forest", {"n_estimators": 1, "max_depth": 1, "bootstrap": False}).transform(rows), "y_pred")


# The library's trees merge leaves of one class, so the halves must differ in their majority.
@query("j9_classifier_one_tree", tidy_sql(f"""{TRAIN} SELECT {HALF} AS half, avg(CASE WHEN X1 > 6 - 4 * {HALF} THEN 1 ELSE 0 END) AS score, count(*) AS n
  FROM train GROUP BY half""", "score"))
def j9_classifier_one_tree(spark, sf_dir):
    rows = halves(train_rows(spark, sf_dir)).withColumn("label", (F.col("X1") > 6 - 4 * F.col("half")).cast("int"))
    params = {"n_estimators": 1, "max_depth": 1, "bootstrap": False}
    return by_half(models.fit_model(rows, ["half"], "label", "random_forest_classifier", params).transform(rows), "score")


# Without a penalty the second-degree fit is least squares on the scaled column and its square.
@query("j10_polynomial_unpenalised", tidy_sql(f"""{TRAIN}, s AS (SELECT avg(X1) AS m, stddev_samp(X1) AS sd FROM train),
  t AS (SELECT split, {TARGET} AS y, (X1 - m) / sd AS z, ((X1 - m) / sd) ** 2 AS q FROM joined, s),
  c AS (SELECT var_pop(z) AS a, covar_pop(z, q) AS b, var_pop(q) AS d, covar_pop(z, y) AS e, covar_pop(q, y) AS f, avg(z) AS mz, avg(q) AS mq, avg(y) AS my
    FROM t WHERE split = 'train'),
  w AS (SELECT *, (e * d - b * f) / (a * d - b * b) AS b1, (a * f - b * e) / (a * d - b * b) AS b2 FROM c)
  SELECT split, avg((y - my - b1 * (z - mz) - b2 * (q - mq)) ** 2) AS mse FROM t, w GROUP BY split""", "mse"))
def j10_unpenalised(spark, sf_dir):
    joined = split_people(spark, sf_dir)
    fitted = models.fit_model(joined.where("split = 'train'"), ["X1"], TARGET, "polynomial_lasso", {"alpha": 0.0})
    error = F.col(TARGET) - F.col("y_pred")
    return tidy(fitted.transform(joined).groupBy("split").agg(F.avg(error * error).alias("mse")))


# On a binary column the likelihood is greatest at the class shares.
@query("j11_logistic_shares", tidy_sql(f"{TRAIN} SELECT {HALF} AS half, avg({LABEL}) AS score, count(*) AS n FROM train GROUP BY half", "score", 4))
def j11_shares(spark, sf_dir):
    rows = halves(train_rows(spark, sf_dir))
    return tidy(by_half(models.fit_model(rows, ["half"], "label", "logistic", {}).transform(rows), "score"), 4)


# One Newton step of the log-odds in each half.
@query("j12_boosted_classifier_step", tidy_sql(f"""{TRAIN}, p AS (SELECT avg({LABEL}) AS p FROM train), h AS (SELECT {HALF} AS half, avg({LABEL}) AS share, count(*) AS n FROM train GROUP BY half)
  SELECT half, 1 / (1 + exp(-(ln(p / (1 - p)) + 0.1 * (share - p) / (p * (1 - p))))) AS score, n FROM h, p""", "score"))
def j12_step(spark, sf_dir):
    rows = halves(train_rows(spark, sf_dir))
    return by_half(models.fit_model(rows, ["half"], "label", "boosted_classifier", {"max_iter": 1, "max_depth": 1}).transform(rows), "score")


# A column that is the label itself is separated without error.
@query("j13_linear_svm_separable", f"{TRAIN} SELECT {HALF} AS half, CAST({HALF} AS DOUBLE) AS y_pred, count(*) AS n FROM train GROUP BY ALL")
def j13_separable(spark, sf_dir):
    rows = halves(train_rows(spark, sf_dir)).drop("label").withColumn("label", F.col("half"))
    return models.fit_model(rows, ["half"], "label", "linear_svm", {"C": 1, "max_iter": 50}).transform(rows).groupBy("half", "y_pred").agg(F.count("*").alias("n"))


# Each step takes the same share of what is left of the two group means.
@query("j21_staged_two_means", tidy_sql(f"""{JOINED}, r AS (SELECT split, {HALF} AS half, {TARGET} AS y FROM joined),
  m AS (SELECT avg(y) AS base FROM r WHERE split = 'train'), g AS (SELECT half, avg(y) AS mean FROM r WHERE split = 'train' GROUP BY half),
  s AS (SELECT t AS iteration, split, 1 - avg((y - base - (1 - 0.7 ** t) * (mean - base)) ** 2) / var_pop(y) AS r2
    FROM r JOIN g USING (half), m, (VALUES (5), (10), (15), (20)) v(t) WHERE split <> 'validation' GROUP BY t, split),
  w AS (SELECT iteration, max(r2) FILTER (split = 'train') AS train_r2, max(r2) FILTER (split = 'test') AS test_r2 FROM s GROUP BY iteration)
  SELECT iteration, train_r2, test_r2 FROM w""", "train_r2 test_r2"))
def j21_two_means(spark, sf_dir):
    joined = halves(split_people(spark, sf_dir))
    train, test = joined.where("split = 'train'"), joined.where("split = 'test'")
    params = {"max_iter": 20, "learning_rate": 0.3, "max_depth": 1, "min_samples_leaf": 1}
    fitted = models.fit_model(train, ["half"], TARGET, "hist_gradient_boosting", params)
    return tidy(models.staged_scores(fitted, train, test, TARGET, every=5).drop("best"))


@query("j22_depth_sweep_two_means", tidy_sql(f"""{TRAIN}, f AS (SELECT {HALF} AS half, {TARGET} AS y, ntile(3) OVER (ORDER BY row_id) - 1 AS fold FROM train),
  k AS (SELECT DISTINCT fold FROM f), b AS (SELECT k.fold, avg(y) AS base FROM f JOIN k ON f.fold <> k.fold GROUP BY k.fold),
  g AS (SELECT k.fold, half, avg(y) AS mean FROM f JOIN k ON f.fold <> k.fold GROUP BY k.fold, half),
  s AS (SELECT f.fold, 1 - avg((y - base - (1 - 0.9 ** 5) * (mean - base)) ** 2) / var_pop(y) AS r2 FROM f JOIN b ON f.fold = b.fold JOIN g ON f.fold = g.fold AND f.half = g.half GROUP BY f.fold)
  SELECT d AS max_depth, avg(r2) AS mean_test_score, stddev_pop(r2) AS std_test_score FROM s, (VALUES (1), (3)) v(d) GROUP BY d""", "mean_test_score std_test_score"))
def j22_two_means(spark, sf_dir):
    return tidy(models.depth_sweep(halves(train_rows(spark, sf_dir)), ["half"], TARGET, [1, 3], folds=3, max_iter=5))


# --- whole runs -----------------------------------------------------------------
RUN = f"""{TRAIN}, f AS (SELECT {TARGET} AS y, X1 AS x, ntile(3) OVER (ORDER BY row_id) - 1 AS fold FROM train),
  a AS (SELECT * FROM (VALUES ('LinearRegression', 0.0), {", ".join(f"('Ridge', {v})" for v in ALPHAS)}) v(model, alpha)),
  s AS (SELECT k.fold, count(*) AS n, avg(y) AS yb, avg(x) AS xb, stddev_pop(x) AS sd, covar_pop(y, x) / stddev_pop(x) AS g
    FROM f JOIN (SELECT DISTINCT fold FROM f) k ON f.fold <> k.fold GROUP BY k.fold),
  t AS (SELECT model, alpha, s.fold, 1 - avg((y - yb - g * n / (n + alpha) * (x - xb) / sd) ** 2) / var_pop(y) AS r2 FROM s JOIN f ON f.fold = s.fold, a GROUP BY ALL),
  c AS (SELECT model, alpha, avg(r2) AS cv_r2_mean, stddev_pop(r2) AS cv_r2_std FROM t GROUP BY model, alpha QUALIFY row_number() OVER (PARTITION BY model ORDER BY avg(r2) DESC) = 1),
  m AS (SELECT count(*) AS n, avg({TARGET}) AS yb, avg(X1) AS xb, stddev_pop(X1) AS sd, covar_pop({TARGET}, X1) / stddev_pop(X1) AS g FROM train),
  w AS (SELECT c.*, yb, xb, sd, g * n / (n + alpha) AS b FROM m, c),
  e AS (SELECT w.*, split, {TARGET} AS y, {TARGET} - yb - b * (X1 - xb) / sd AS error FROM joined, w)"""
SIDES = ", ".join(
    f"1 - avg(error * error) FILTER (split = '{s}') / var_pop(y) FILTER (split = '{s}') AS {s}_r2, avg(abs(error)) FILTER (split = '{s}') AS {s}_mae, avg(error * error) FILTER (split = '{s}') AS {s}_mse"
    for s in ("test", "validation")
)
SCORES = "cv_r2_mean cv_r2_std test_r2 test_mae test_mse validation_r2 validation_mae validation_mse"


@query("j24_run_experiment_line", tidy_sql(f"""{RUN} SELECT model, CASE WHEN model = 'Ridge' THEN alpha END AS alpha, 1 AS feature_count, cv_r2_mean, cv_r2_std, {SIDES}
  FROM e GROUP BY model, alpha, cv_r2_mean, cv_r2_std""", SCORES))
def j24_line(spark, sf_dir):
    """A run on one column: folds, choice of the penalty, refit, predictions and both score tables."""
    from quintil.plans.experiment import Experiment, run_experiment

    df = people(spark, sf_dir).select("row_id", TARGET, "X1")
    spec = Experiment("line", {"linear_regression": {}, "ridge": {"alpha": list(ALPHAS)}}, diagnostics=False)
    scores = run_experiment(spec, df, splits.random_split(df), "run_a").comparison
    alpha = F.get_json_object("best_params", "$.alpha").cast("double").alias("alpha")
    return tidy(scores.select("model", alpha, "feature_count", *SCORES.split()))


@query("k8_fixed_effect_scores", tidy_sql(f"""{TRAIN}, f AS (SELECT Region, {TARGET} AS y, ntile(3) OVER (ORDER BY row_id) - 1 AS fold FROM train),
  g AS (SELECT k.fold, Region, avg(y) AS mean FROM f JOIN (SELECT DISTINCT fold FROM f) k ON f.fold <> k.fold GROUP BY k.fold, Region),
  s AS (SELECT f.fold, 1 - avg((y - mean) ** 2) / var_pop(y) AS r2 FROM f JOIN g ON f.fold = g.fold AND f.Region = g.Region GROUP BY f.fold),
  m AS (SELECT Region, avg({TARGET}) AS mean FROM train GROUP BY Region),
  e AS (SELECT split, {TARGET} AS y, {TARGET} - mean AS error FROM joined JOIN m USING (Region))
  SELECT 'region_fe' AS effect, 'LinearRegression' AS model, (SELECT avg(r2) FROM s) AS cv_r2_mean,
    1 - avg(error * error) FILTER (split = 'test') / var_pop(y) FILTER (split = 'test') AS test_r2,
    1 - avg(error * error) FILTER (split = 'validation') / var_pop(y) FILTER (split = 'validation') AS validation_r2 FROM e""", "cv_r2_mean test_r2 validation_r2"))
def k8_scores(spark, sf_dir):
    """The study with one effect and no other information predicts the means of its levels."""
    from quintil.plans.experiment import Experiment, fixed_effect_study

    df = people(spark, sf_dir).select("row_id", TARGET, "Region")
    scores, _ = fixed_effect_study(Experiment("linear", {"linear_regression": {}}, categorical=["Region"]), df, splits.random_split(df), ["region_fe"])
    return tidy(scores.select("effect", "model", "cv_r2_mean", "test_r2", "validation_r2"))


@query("j19_predict_frame_rows", tidy_sql(f"""{TRAIN}, l AS (SELECT regr_slope({TARGET}, X1) AS b, regr_intercept({TARGET}, X1) AS a FROM train),
  p AS (SELECT split, row_id, {TARGET} AS y_true, a + b * X1 AS y_pred FROM joined, l WHERE split <> 'train')
  SELECT 'run_a' AS run_id, 'Line' AS model, *, y_true - y_pred AS residual, abs(y_true - y_pred) AS abs_error, (y_true - y_pred) ** 2 AS squared_error FROM p""",
  "y_true y_pred residual abs_error squared_error"))
def j19_rows(spark, sf_dir):
    from quintil.ml import linear
    from quintil.plans.experiment import predict_frame

    joined = split_people(spark, sf_dir)
    fit, _, _ = linear.fit_view(linear.cross_products(joined.where("split = 'train'"), ["X1"], TARGET), -1)
    return tidy(predict_frame(joined.where("split <> 'train'"), fit.predict_column(), "run_a", "Line", TARGET))


# --- screens and importance of trees --------------------------------------------
SCREENED = ("ANO4", "TRIMESTRE", "AGLOMERADO")


@query("j23_screen_all_models", tidy_sql(f"""{JOINED}, l AS (SELECT split, {TARGET} AS y, unnest([{", ".join(f"struct_pack(c := '{c}', x := CAST({c} AS DOUBLE))" for c in SCREENED)}], recursive := true) FROM joined),
  m AS (SELECT c, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM l WHERE split = 'train' GROUP BY c),
  b AS (SELECT avg({TARGET}) AS base FROM joined WHERE split = 'train'),
  h AS (SELECT c, x, sum(y - base) AS s, count(*) AS n FROM l, b WHERE split = 'train' GROUP BY c, x),
  u AS (SELECT c, x, sum(s) OVER w AS ls, sum(n) OVER w AS ln, sum(s) OVER (PARTITION BY c) AS s, sum(n) OVER (PARTITION BY c) AS n FROM h WINDOW w AS (PARTITION BY c ORDER BY x)),
  t AS (SELECT *, ls / ln AS low, (s - ls) / (n - ln) AS high FROM u WHERE ln < n QUALIFY row_number() OVER (PARTITION BY c ORDER BY ls * ls / ln + (s - ls) ** 2 / (n - ln) DESC, x) = 1),
  p AS (SELECT l.c, 'linear_regression' AS model, y, intercept + slope * x AS p FROM l JOIN m ON l.c = m.c WHERE split = 'test'
    UNION ALL SELECT l.c, 'hist_gradient_boosting', y, base + CASE WHEN l.x <= t.x THEN low ELSE high END FROM l JOIN t ON l.c = t.c, b WHERE split = 'test')
  SELECT c AS "column", model, 1 - avg((y - p) ** 2) / var_pop(y) AS test_r2, avg((y - p) ** 2) AS test_mse FROM p GROUP BY c, model""", "test_r2 test_mse"))
def j23_all_models(spark, sf_dir):
    """Lines from moments and trees from histograms, each of all columns in one pass."""
    trees = {"max_iter": 1, "max_leaf_nodes": 2, "learning_rate": 1.0, "min_samples_leaf": 1}
    screen = models.univariate_screen(split_people(spark, sf_dir), SCREENED, TARGET, {"linear_regression": {}, "hist_gradient_boosting": trees})
    return tidy(screen)


@query("j20_importance_of_trees", tidy_sql(f"""{TRAIN}, g AS (SELECT {HALF} AS half, avg({TARGET}) AS mean FROM train GROUP BY half),
  t AS (SELECT row_id, {TARGET} AS y, {HALF} AS half, row_number() OVER (ORDER BY row_id) AS i FROM joined WHERE split <> 'train'),
  base AS (SELECT 1 - avg((y - mean) ** 2) / var_pop(y) AS r2, avg(abs(y - mean)) AS mae FROM t JOIN g USING (half)),
  p AS (SELECT k, half, row_number() OVER (PARTITION BY k ORDER BY md5(CAST(42 + k AS VARCHAR) || ':' || row_id)) AS i FROM t, range(3) q(k)),
  s AS (SELECT p.k, 1 - avg((y - mean) ** 2) / var_pop(y) AS r2, avg(abs(y - mean)) AS mae FROM t JOIN p USING (i) JOIN g ON p.half = g.half GROUP BY p.k)
  SELECT 'TIME' AS feature_or_group, 1 AS n_cols, (SELECT r2 FROM base) AS base_score, avg((SELECT r2 FROM base) - r2) AS importance_mean,
    stddev_samp((SELECT r2 FROM base) - r2) AS importance_std, (SELECT mae FROM base) AS base_mae, avg(mae - (SELECT mae FROM base)) AS imp_mae_mean,
    stddev_samp(mae - (SELECT mae FROM base)) AS imp_mae_std FROM s
  UNION ALL SELECT 'X1', 1, r2, 0.0, 0.0, mae, 0.0, 0.0 FROM base""", "base_score importance_mean importance_std base_mae imp_mae_mean imp_mae_std"))
def j20_trees(spark, sf_dir):
    """A boosted model that knows only a binary column; a column that it does not use has no importance."""
    from quintil.ml import importance

    joined = halves(split_people(spark, sf_dir))
    params = {"max_iter": 1, "max_depth": 1, "min_samples_leaf": 1, "learning_rate": 1.0}
    fitted = models.fit_model(joined.where("split = 'train'"), ["half"], TARGET, "hist_gradient_boosting", params)
    return tidy(importance.permutation_importance(fitted.transform, joined.where("split <> 'train'"), TARGET, {"TIME": ["half"]}, ["half", "X1"], repeats=3))
