"""Queries of the modelling stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from quintil.catalog.base import JOINED, SURVEY, people, query, split_people, survey, table, tidy, tidy_sql
from quintil.ml import design, importance, linear, models, neighbors
from quintil.operators import effects, selection, splits
from quintil.operators.order import add_row_id
from quintil.session import settle

W = f"WITH {SURVEY}"
TRAIN = f"{JOINED}, train AS (SELECT * FROM joined WHERE split = 'train')"
TARGET = "logP47T"


def train_rows(spark, sf_dir):
    return split_people(spark, sf_dir).filter(F.col("split") == "train")


@query("j1_impute", tidy_sql(f"""{W}, c AS (SELECT 'PROP' AS "column", CAST(PROP AS VARCHAR) AS v, count(*) AS n FROM survey WHERE PROP IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'Region', Region, count(*) FROM survey GROUP BY ALL)
  SELECT 'P03' AS "column", quantile_cont(CAST(P03 AS DOUBLE), 0.5) AS median, NULL AS mode FROM survey
  UNION ALL SELECT 'P21', quantile_cont(P21, 0.5), NULL FROM survey
  UNION ALL SELECT "column", NULL, v FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS k FROM c) WHERE k = 1""", "median"))
def j1(spark, sf_dir):
    return tidy(design.impute_statistics(survey(spark, sf_dir), ["P03", "P21"], ["PROP", "Region"]))


@query("j2_scale", tidy_sql(f"""{W} SELECT person_key, (P03 - (SELECT avg(P03) FROM survey)) / (SELECT stddev_pop(P03) FROM survey) AS P03,
  (P21 - (SELECT avg(P21) FROM survey)) / (SELECT stddev_pop(P21) FROM survey) AS P21 FROM survey""", "P03 P21"))
def j2(spark, sf_dir):
    return tidy(design.scaled(survey(spark, sf_dir).select("person_key", "P03", "P21"), ["P03", "P21"]))


@query("j3_one_hot", f"""{W}, m AS (SELECT CAST(PROP AS VARCHAR) AS v FROM survey WHERE PROP IS NOT NULL GROUP BY PROP ORDER BY count(*) DESC, v LIMIT 1)
  SELECT 'cat__Region_' || Region AS feature, count(*) AS n FROM survey GROUP BY ALL
  UNION ALL SELECT 'cat__PROP_' || coalesce(CAST(PROP AS VARCHAR), (SELECT v FROM m)), count(*) FROM survey GROUP BY ALL""")
def j3(spark, sf_dir):
    return design.one_hot_counts(survey(spark, sf_dir), ["Region", "PROP"])


def one_feature(spark, sf_dir, model, alpha=0.0, ratio=1.0):
    products = linear.cross_products(train_rows(spark, sf_dir), ["X1"], TARGET)
    fit, train_r2, _ = linear.fit_view(products, -1, alpha, ratio)
    return tidy(
        linear.coefficient_frame(spark, fit, model).select("feature", "coefficient")
        .withColumns({"intercept": F.lit(fit.intercept), "train_r2": F.lit(train_r2)})
    )


def one_feature_sql(weight: str) -> str:
    """Weight on the scaled column from g, the covariance of target and scaled column."""
    return tidy_sql(f"""{TRAIN}, s AS (SELECT count(*) AS n, avg({TARGET}) AS yb, avg(X1) AS xb, stddev_pop(X1) AS sd, covar_pop({TARGET}, X1) / stddev_pop(X1) AS g, var_pop({TARGET}) AS vy FROM train),
      w AS (SELECT *, {weight} AS w FROM s)
      SELECT 'num__X1' AS feature, w AS coefficient, yb AS intercept, 1 - (vy - 2 * w * g + w * w) / vy AS train_r2 FROM w""", "coefficient intercept train_r2")


@query("j4_linear_regression", one_feature_sql("g"))
def j4(spark, sf_dir):
    return one_feature(spark, sf_dir, "LinearRegression", 0.0, None)


@query("j5_ridge", one_feature_sql("g * n / (n + 250.0)"))
def j5(spark, sf_dir):
    return one_feature(spark, sf_dir, "Ridge", 250.0, None)


# One set of levels under ridge: a level's weight is its mean less the intercept, drawn in by n / (n + alpha); the
# intercept is the mean of the level means with weights n / (n + alpha).
@query("j5_ridge_sparse_levels", tidy_sql(f"""{TRAIN}, g AS (SELECT CAST(AGLOMERADO AS VARCHAR) AS level, count(*) AS n, avg({TARGET}) AS m FROM train GROUP BY ALL),
  b AS (SELECT sum(n / (n + 40.0) * m) / sum(n / (n + 40.0)) AS b FROM g)
  SELECT 'cat__AGLOMERADO_' || level AS feature, n / (n + 40.0) * (m - b) AS coefficient, b AS intercept FROM g, b""", "coefficient intercept", 5))
def j5_sparse(spark, sf_dir):
    products = linear.training_set(train_rows(spark, sf_dir), ["AGLOMERADO"], TARGET, categorical=["AGLOMERADO"], matrix_levels=0)
    fit, _, _ = products.fit(-1, 40.0)
    products.close()
    weights = linear.coefficient_frame(spark, fit, "Ridge").select("feature", "coefficient")
    return tidy(weights.withColumn("intercept", F.lit(float(fit.model.intercept))), 5)


@query("j6_lasso", one_feature_sql("sign(g) * greatest(abs(g) - 0.0005, 0)"))
def j6(spark, sf_dir):
    return one_feature(spark, sf_dir, "Lasso", 0.0005, 1.0)


@query("j7_elastic_net", one_feature_sql("sign(g) * greatest(abs(g) - 0.001 * 0.2, 0) / (1 + 0.001 * 0.8)"))
def j7(spark, sf_dir):
    return one_feature(spark, sf_dir, "ElasticNet", 0.001, 0.2)


ALPHAS = (1.0, 100.0, 1000.0, 5000.0)
FOLDED = f"""{TRAIN}, f AS (SELECT {TARGET} AS y, X1 AS x, ntile(3) OVER (ORDER BY row_id) - 1 AS fold FROM train),
  a AS (SELECT * FROM (VALUES {", ".join(f"({v})" for v in ALPHAS)}) v(alpha)),
  s AS (SELECT k.fold, count(*) AS n, avg(y) AS yb, avg(x) AS xb, stddev_pop(x) AS sd, covar_pop(y, x) / stddev_pop(x) AS g, var_pop(y) AS vy
    FROM f JOIN (SELECT DISTINCT fold FROM f) k ON f.fold <> k.fold GROUP BY k.fold),
  w AS (SELECT fold, alpha, yb, xb, sd, g * n / (n + alpha) AS w, g, vy FROM s, a),
  t AS (SELECT w.fold, w.alpha, 1 - sum((y - yb - w * (x - xb) / sd) ** 2) / (var_pop(y) * count(*)) AS test, any_value(1 - (vy - 2 * w * g + w * w) / vy) AS train
    FROM w JOIN f ON f.fold = w.fold GROUP BY ALL),
  cv AS (SELECT alpha, avg(test) AS mean_test_score, stddev_pop(test) AS std_test_score, avg(train) AS mean_train_score FROM t GROUP BY alpha)"""


@query("j15_grid_search_cv", tidy_sql(f"""{FOLDED} SELECT 'Ridge' AS model, CAST(alpha AS DOUBLE) AS param_reg__alpha, mean_test_score, std_test_score, mean_train_score,
  CAST(rank() OVER (ORDER BY mean_test_score DESC) AS INT) AS rank_test_score FROM cv""", "mean_test_score std_test_score mean_train_score"))
def j15(spark, sf_dir):
    products = linear.cross_products(train_rows(spark, sf_dir), ["X1"], TARGET, 3)
    result = linear.grid_search(products, "ridge", ALPHAS)
    return tidy(linear.cv_frame(spark, result).drop("mean_fit_time", "param_reg__l1_ratio"))


@query("j17_regularization_path", tidy_sql(f"""{FOLDED}, z AS (SELECT count(*) AS n, covar_pop(y, x) / stddev_pop(x) AS g FROM f)
  SELECT 'Ridge' AS model, CAST(alpha AS DOUBLE) AS alpha, mean_train_score AS mean_train_r2, mean_test_score AS mean_cv_r2, std_test_score AS std_cv_r2,
    abs(g * n / (n + alpha)) AS coefficient_l1_norm, abs(g * n / (n + alpha)) AS coefficient_l2_norm, 1 AS nonzero_coefficients FROM cv, z""",
  "mean_train_r2 mean_cv_r2 std_cv_r2 coefficient_l1_norm coefficient_l2_norm"))
def j17(spark, sf_dir):
    products = linear.cross_products(train_rows(spark, sf_dir), ["X1"], TARGET, 3)
    return tidy(linear.regularization_path(spark, products, "ridge", ALPHAS).drop("mean_fit_time"))


@query("f4_cv_rank", f"{FOLDED} SELECT CAST(alpha AS DOUBLE) AS alpha, rank() OVER (ORDER BY mean_test_score DESC) AS rank_test_score FROM cv")
def f4(spark, sf_dir):
    products = linear.cross_products(train_rows(spark, sf_dir), ["X1"], TARGET, 3)
    cv = linear.cv_frame(spark, linear.grid_search(products, "ridge", ALPHAS)).drop("rank_test_score")
    return selection.cv_rank(cv).select(F.col("param_reg__alpha").alias("alpha"), "rank_test_score")


# Least squares on one set of levels: the minimum-norm weights are the level
# means less their unweighted average.
def level_sql(column: str, prefix: str) -> str:
    return f"""{TRAIN}, g AS (SELECT CAST({column} AS VARCHAR) AS level, avg({TARGET}) AS m FROM train GROUP BY {column}),
      c AS (SELECT level, '{prefix}' || level AS feature, m - avg(m) OVER () AS coefficient FROM g)"""


def level_fit(spark, sf_dir, column, name):
    df, features, facts = effects.apply_fixed_effects(
        train_rows(spark, sf_dir), [], [{"name": name, "columns": [column], "max_levels": 100, "drop_first": True}]
    )
    products = linear.cross_products(df, features, TARGET, categorical=features)
    fit, _, _ = linear.fit_view(products, -1)
    return linear.coefficient_frame(spark, fit, "LinearRegression", "run_a"), facts


@query("j18_coefficient_table", tidy_sql(level_sql("AGLOMERADO", "cat__fe_aglo_fe_") + """ SELECT 'run_a' AS run_id, 'LinearRegression' AS model, feature,
  coefficient, abs(coefficient) AS abs_coefficient, row_number() OVER (ORDER BY abs(coefficient) DESC, feature) AS abs_rank FROM c""", "coefficient abs_coefficient"))
def j18(spark, sf_dir):
    return tidy(selection.coefficient_table(level_fit(spark, sf_dir, "AGLOMERADO", "aglo_fe")[0]))


@query("f2_coef_rank", level_sql("CAT_OCUP", "cat__fe_cat_fe_") + " SELECT feature, row_number() OVER (ORDER BY abs(coefficient) DESC, feature) AS abs_rank FROM c")
def f2(spark, sf_dir):
    return selection.coefficient_table(level_fit(spark, sf_dir, "CAT_OCUP", "cat_fe")[0]).select("feature", "abs_rank")


@query("e31_coefficient_norms", tidy_sql(level_sql("AGLOMERADO", "x") + """ SELECT 'run_a' AS run_id, 'LinearRegression' AS model, sum(abs(coefficient)) AS coefficient_l1_norm,
  sqrt(sum(coefficient * coefficient)) AS coefficient_l2_norm, count(*) FILTER (WHERE abs(coefficient) > 1e-10) AS nonzero_coefficients FROM c""", "coefficient_l1_norm coefficient_l2_norm"))
def e31(spark, sf_dir):
    return tidy(selection.coefficient_norms(level_fit(spark, sf_dir, "AGLOMERADO", "aglo_fe")[0]))


EFFECT = """ SELECT 'run_a' AS run_id, 'LinearRegression' AS model, '{n}' AS fe_name, level, feature, coefficient, abs(coefficient) AS abs_coefficient,
  CASE WHEN coefficient > 0 THEN 'positive' WHEN coefficient < 0 THEN 'negative' ELSE 'zero' END AS sign, row_number() OVER (ORDER BY abs(coefficient) DESC, feature) AS rank FROM c"""


@query("f3_fe_coef_rank", tidy_sql(level_sql("AGLOMERADO", "cat__fe_aglo_fe_") + EFFECT.format(n="aglo_fe"), "coefficient abs_coefficient"))
def f3(spark, sf_dir):
    coefficients, facts = level_fit(spark, sf_dir, "AGLOMERADO", "aglo_fe")
    return tidy(selection.effect_coefficients(selection.coefficient_table(coefficients), facts))


@query("k8_fixed_effect_study", tidy_sql(level_sql("Region", "cat__fe_region_fe_") + EFFECT.format(n="region_fe"), "coefficient abs_coefficient"))
def k8(spark, sf_dir):
    coefficients, facts = level_fit(spark, sf_dir, "Region", "region_fe")
    return tidy(selection.effect_coefficients(selection.coefficient_table(coefficients), facts))


@query("k8_fixed_effect_runs")
def k8_runs(spark, sf_dir):
    """The full study: one linear run per effect design."""
    from quintil.plans.experiment import Experiment, fixed_effect_study

    df = people(spark, sf_dir)
    spec = Experiment("linear", {"linear_regression": {}, "ridge": {"alpha": [2.0]}}, categorical=["Region", "CAT_OCUP", "AGLOMERADO"])
    scores, _ = fixed_effect_study(spec, df, splits.random_split(df))
    return tidy(scores.select("effect", "model", "feature_count", "cv_r2_mean", "test_r2", "validation_r2"))


@query("g7_top_k_per_block", tidy_sql(level_sql("AGLOMERADO", "cat__fe_aglo_fe_") + """ SELECT 'geography' AS block, feature, coefficient, level AS label,
  row_number() OVER (ORDER BY abs(coefficient) DESC, feature) AS position FROM c QUALIFY position <= 7""", "coefficient"))
def g7(spark, sf_dir):
    coefficients = level_fit(spark, sf_dir, "AGLOMERADO", "aglo_fe")[0].select("feature", "coefficient")
    return tidy(selection.top_k_per_block(coefficients, {"geography": "cat__fe_aglo_fe_", "housing": "cat__H05_"}, "coefficient", 7))


@query("d7_coef_join", tidy_sql(f"""{TRAIN}, s AS (SELECT count(*) AS n, covar_pop({TARGET}, X1) / stddev_pop(X1) AS g FROM train)
  SELECT 'num__X1' AS feature, round(g, 4) AS "LR", round(g * n / (n + 250.0), 4) AS "Ridge", round(sign(g) * greatest(abs(g) - 0.0005, 0), 4) AS "Lasso" FROM s""", "LR Ridge Lasso"))
def d7(spark, sf_dir):
    products = linear.cross_products(train_rows(spark, sf_dir), ["X1"], TARGET)
    fits = {"LR": (0.0, None), "Ridge": (250.0, None), "Lasso": (0.0005, 1.0)}
    tables = {n: linear.coefficient_frame(spark, linear.fit_view(products, -1, a, r)[0], n) for n, (a, r) in fits.items()}
    return tidy(selection.join_coefficients(tables))


# --- screens and importance -----------------------------------------------------
SCREENED = ("X1", "ANO4", "TRIMESTRE", "AGLOMERADO")
LINES = f"""{JOINED}, l AS (SELECT split, {TARGET} AS y, unnest([{", ".join(f"struct_pack(c := '{c}', x := CAST({c} AS DOUBLE))" for c in SCREENED)}], recursive := true) FROM joined),
  m AS (SELECT c, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM l WHERE split = 'train' GROUP BY c),
  r AS (SELECT c AS "column", slope, intercept, 'LinearRegression' AS model, 1 - avg((y - intercept - slope * x) ** 2) / var_pop(y) AS test_r2,
    avg((y - intercept - slope * x) ** 2) AS test_mse FROM l JOIN m USING (c) WHERE split = 'test' GROUP BY ALL)"""


@query("j23_univariate_screen", tidy_sql(f"{LINES} SELECT * FROM r", "slope intercept test_r2 test_mse"))
def j23(spark, sf_dir):
    return tidy(models.univariate_lines(split_people(spark, sf_dir), SCREENED, TARGET))


@query("g10_best_per_column", tidy_sql(f"""{LINES}, z AS (SELECT "column", model, test_r2 FROM r UNION ALL SELECT 'X1', 'Mean', 1 - avg((y - (SELECT avg({TARGET}) FROM joined WHERE split = 'train')) ** 2) / var_pop(y) FROM l WHERE split = 'test' AND c = 'X1'),
  b AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY test_r2 DESC, model DESC) AS k FROM z)
  SELECT "column", model, test_r2, test_r2 = (SELECT max(test_r2) FROM b) AS overall FROM b WHERE k = 1""", "test_r2"))
def g10(spark, sf_dir):
    joined = split_people(spark, sf_dir)
    lines = models.univariate_lines(joined, SCREENED, TARGET).select("column", "model", "test_r2")
    mean = joined.filter(F.col("split") == "train").agg(F.avg(TARGET)).first()[0]
    error = F.col(TARGET) - F.lit(mean)
    constant = joined.filter(F.col("split") == "test").agg((1 - F.avg(error * error) / F.var_pop(TARGET)).alias("test_r2"))
    results = lines.unionByName(constant.select(F.lit("X1").alias("column"), F.lit("Mean").alias("model"), "test_r2"))
    return tidy(selection.best_per_column(results))


IMPORTANCE = f"""{TRAIN}, z AS (SELECT regr_slope({TARGET}, X1) AS b, regr_intercept({TARGET}, X1) AS a FROM train),
  t AS (SELECT row_id, {TARGET} AS y, X1 AS x, row_number() OVER (ORDER BY row_id) AS i FROM joined WHERE split <> 'train'),
  base AS (SELECT 1 - avg((y - a - b * x) ** 2) / var_pop(y) AS r2, avg(abs(y - a - b * x)) AS mae FROM t, z),
  p AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY md5(CAST(42 + k AS VARCHAR) || ':' || row_id)) AS i FROM t, range(5) q(k)),
  s AS (SELECT p.k, 1 - avg((y - a - b * p.x) ** 2) / var_pop(y) AS r2, avg(abs(y - a - b * p.x)) AS mae FROM t JOIN p USING (i), z GROUP BY p.k),
  imp AS (SELECT 'X1' AS feature_or_group, 1 AS n_cols, (SELECT r2 FROM base) AS base_score, avg((SELECT r2 FROM base) - r2) AS importance_mean,
    stddev_samp((SELECT r2 FROM base) - r2) AS importance_std, (SELECT mae FROM base) AS base_mae, avg(mae - (SELECT mae FROM base)) AS imp_mae_mean,
    stddev_samp(mae - (SELECT mae FROM base)) AS imp_mae_std FROM s)"""
IMP_COLUMNS = "base_score importance_mean importance_std base_mae imp_mae_mean imp_mae_std"


@query("j20_permutation_importance", tidy_sql(f"{IMPORTANCE} SELECT * FROM imp", IMP_COLUMNS))
def j20(spark, sf_dir):
    joined = split_people(spark, sf_dir)
    products = linear.cross_products(joined.filter(F.col("split") == "train"), ["X1"], TARGET)
    fit, _, _ = linear.fit_view(products, -1)
    return tidy(importance.linear_importance(fit, joined.filter(F.col("split") != "train"), TARGET, {}, ["X1"], repeats=5))


@query("g6_top_k_per_model", tidy_sql(f"{IMPORTANCE} SELECT 'LR' AS model, feature_or_group, importance_mean, 1 AS position FROM imp", "importance_mean"))
def g6(spark, sf_dir):
    table_ = j20(spark, sf_dir).withColumn("model", F.lit("LR"))
    return tidy(selection.top_k(table_, "importance_mean", 10).select("model", "feature_or_group", "importance_mean", "position"))


@query("j20_permutation_importance_blocks")
def j20_blocks(spark, sf_dir):
    """Blocks and single columns of a model on several features."""
    joined = split_people(spark, sf_dir)
    features = ["X1", "ANO4", "TRIMESTRE", "Region", "CAT_OCUP", "AGLOMERADO"]
    products = linear.cross_products(joined.filter(F.col("split") == "train"), features, TARGET, categorical=["AGLOMERADO"])
    fit, _, _ = linear.fit_view(products, -1, 2.0)
    blocks = {"GEOGRAFIA": ["Region", "AGLOMERADO"], "TIEMPO": ["ANO4", "TRIMESTRE"]}
    return tidy(importance.linear_importance(fit, joined.filter(F.col("split") == "test"), TARGET, blocks, features, repeats=5))


# --- trees, classifiers, neighbours ---------------------------------------------
FEATURES = ["X1", "ANO4", "TRIMESTRE", "Region", "CAT_OCUP"]


def scored(spark, sf_dir, model, params):
    joined = split_people(spark, sf_dir)
    fitted = models.fit_model(joined.filter(F.col("split") == "train"), FEATURES, TARGET, model, params)
    error = F.col(TARGET) - F.col("y_pred")
    return fitted.transform(joined).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.avg(error * error).alias("mse"), F.var_pop(TARGET).alias("variance")
    )


@query("j8_boosted_trees")
def j8(spark, sf_dir):
    return scored(spark, sf_dir, "hist_gradient_boosting", {"max_iter": 10, "max_leaf_nodes": 15, "min_samples_leaf": 20})


# A tree's splits from its gains: numeric cuts are at most a value, level cuts equal one.
CUTS = (("ANO4", True), ("TRIMESTRE", True), ("Region", False), ("CAT_OCUP", False))
BOOST_FEATURES = [c for c, _ in CUTS]


def boosted_sql(penalties: tuple[float, ...], leaves: int, select: str) -> str:
    """One best-first tree of two or three leaves for each penalty: ``scored`` has the rows with ``y_pred``."""
    long = " UNION ALL ".join(
        f"SELECT l2, node, {i} AS f, CAST({c} AS VARCHAR) AS v, {c if number else 'NULL'} AS x, g FROM {{0}}" for i, (c, number) in enumerate(CUTS)
    )
    goes = "CASE s.f " + " ".join(f"WHEN {i} THEN {f'{c} <= CAST(s.v AS DOUBLE)' if number else f'{c} = s.v'}" for i, (c, number) in enumerate(CUTS)) + " END"

    def split(source: str, name: str) -> str:
        """Best split of every node of ``source``."""
        return f"""{name}_h AS (SELECT l2, node, f, v, x, sum(g) AS g, count(*) AS n FROM ({long.format(source)}) GROUP BY ALL),
  {name}_w AS (SELECT l2, node, sum(g) AS g, count(*) AS n FROM {source} GROUP BY ALL),
  {name}_c AS (SELECT h.l2, h.node, f, v, x, w.g AS wg, w.n AS wn,
    CASE WHEN x IS NULL THEN h.g ELSE sum(h.g) OVER (PARTITION BY h.l2, h.node, f ORDER BY x) END AS g,
    CASE WHEN x IS NULL THEN h.n ELSE sum(h.n) OVER (PARTITION BY h.l2, h.node, f ORDER BY x) END AS n
    FROM {name}_h h JOIN {name}_w w ON h.l2 = w.l2 AND h.node = w.node),
  {name} AS (SELECT l2, node, f, v, g * g / (n + l2) + (wg - g) ** 2 / (wn - n + l2) - wg * wg / (wn + l2) AS gain
    FROM {name}_c WHERE n < wn QUALIFY row_number() OVER (PARTITION BY l2, node ORDER BY gain DESC, f, x, v) = 1)"""

    again = f""", {split("one", "deep")}, chosen AS (SELECT * FROM deep QUALIFY row_number() OVER (PARTITION BY l2 ORDER BY gain DESC, node) = 1),
  leaf AS (SELECT o.* REPLACE (CASE WHEN o.node = s.node THEN CASE WHEN {goes} THEN 3 ELSE 4 END ELSE o.node END AS node) FROM one o JOIN chosen s ON o.l2 = s.l2)"""
    return f"""{TRAIN}, b AS (SELECT avg({TARGET}) AS base FROM train),
  zero AS (SELECT train.*, l2, 0 AS node, base - {TARGET} AS g, base FROM train, b, (VALUES {", ".join(f"({p})" for p in penalties)}) p(l2)),
  {split("zero", "root")},
  one AS (SELECT z.* REPLACE (CASE WHEN {goes} THEN 1 ELSE 2 END AS node) FROM zero z JOIN root s ON z.l2 = s.l2){again if leaves == 3 else ", leaf AS (SELECT * FROM one)"},
  scored AS (SELECT leaf.*, base + 0.5 * v AS y_pred FROM leaf JOIN (SELECT l2, node, -sum(g) / (count(*) + l2) AS v FROM leaf GROUP BY l2, node) USING (l2, node))
  {select}"""


# One step of one split on a binary feature predicts the two group means.
@query("j8_boosted_one_step", tidy_sql(f"""{JOINED} SELECT CASE WHEN TRIMESTRE > 2 THEN 1 ELSE 0 END AS half, avg(logP47T) AS y_pred
  FROM joined WHERE split = 'train' GROUP BY half""", "y_pred"))
def j8_one_step(spark, sf_dir):
    rows = train_rows(spark, sf_dir).withColumn("half", (F.col("TRIMESTRE") > 2).cast("int"))
    params = {"max_iter": 1, "max_depth": 1, "min_samples_leaf": 1, "learning_rate": 1.0}
    fitted = models.fit_model(rows, ["half"], TARGET, "hist_gradient_boosting", params)
    return tidy(fitted.transform(rows).groupBy("half").agg(F.avg("y_pred").alias("y_pred")))


@query("j8_boosted_two_splits", tidy_sql(boosted_sql((25.0,), 3, """SELECT ANO4, TRIMESTRE, Region, CAT_OCUP, avg(y_pred) AS y_pred, count(*) AS n
  FROM scored GROUP BY ANO4, TRIMESTRE, Region, CAT_OCUP"""), "y_pred"))
def j8_two_splits(spark, sf_dir):
    """The second split goes to the leaf that gains most by it."""
    rows = train_rows(spark, sf_dir)
    params = {"max_iter": 1, "max_leaf_nodes": 3, "min_samples_leaf": 1, "learning_rate": 0.5, "l2_regularization": 25.0}
    fitted = models.fit_model(rows, BOOST_FEATURES, TARGET, "hist_gradient_boosting", params)
    return tidy(fitted.transform(rows).groupBy(*BOOST_FEATURES).agg(F.avg("y_pred").alias("y_pred"), F.count("*").alias("n")))


PENALTIES = (0.0, 100.0, 5000.0)


@query("j8_l2_sweep", tidy_sql(boosted_sql(PENALTIES, 2, f"""SELECT CAST(l2 AS DOUBLE) AS l2_regularization, 1 - sum(({TARGET} - y_pred) ** 2) / (var_pop({TARGET}) * count(*)) AS train_r2,
  min(y_pred) AS low, max(y_pred) AS high FROM scored GROUP BY l2"""), "train_r2 low high"))
def j8_l2_sweep(spark, sf_dir):
    """A penalty pulls both leaves to the mean."""
    from quintil.ml import boosting
    from quintil.operators.metrics import r2

    rows = train_rows(spark, sf_dir)
    encoder = boosting.fit_encoder(rows, BOOST_FEATURES)
    blocks = boosting.blocks_of(rows, encoder, TARGET)
    sweep = None
    for l2 in PENALTIES:
        params = {"max_iter": 1, "max_leaf_nodes": 2, "min_samples_leaf": 1, "learning_rate": 0.5, "l2_regularization": l2}
        scored = boosting.fit_blocks(blocks, encoder, models.boost_settings("hist_gradient_boosting", params)).scored(blocks)
        one = scored.agg(F.lit(l2).alias("l2_regularization"), r2("label", "prediction").alias("train_r2"), F.min("prediction").alias("low"), F.max("prediction").alias("high"))
        sweep = one if sweep is None else sweep.unionByName(one)
    return tidy(sweep)


@query("j9_random_forest")
def j9(spark, sf_dir):
    return scored(spark, sf_dir, "random_forest", {"n_estimators": 10, "max_depth": 5})


@query("j10_polynomial_lasso")
def j10(spark, sf_dir):
    joined = split_people(spark, sf_dir)
    fitted = models.fit_model(joined.filter(F.col("split") == "train"), ["X1", "ANO4", "TRIMESTRE"], TARGET, "polynomial_lasso", {"alpha": 0.001})
    error = F.col(TARGET) - F.col("y_pred")
    return fitted.transform(joined).groupBy("split").agg(F.avg(error * error).alias("mse"))


@query("j21_staged_score")
def j21(spark, sf_dir):
    joined = split_people(spark, sf_dir)
    train, test = joined.filter(F.col("split") == "train"), joined.filter(F.col("split") == "test")
    fitted = models.fit_model(train, FEATURES, TARGET, "hist_gradient_boosting", {"max_iter": 20, "max_depth": 3})
    return models.staged_scores(fitted, train, test, TARGET)


@query("j22_depth_sweep")
def j22(spark, sf_dir):
    return models.depth_sweep(train_rows(spark, sf_dir), FEATURES, TARGET, [2, 4], folds=3, max_iter=5)


CLASS_FEATURES = ["P02", "P03", "P09", "H10", "Region", "ANO4"]


def labelled(spark, sf_dir):
    """Income flag of the survey with a unique integer id."""
    df = survey(spark, sf_dir).select("person_key", "INGRESO", *CLASS_FEATURES)
    return settle(add_row_id(df, ["person_key"]).drop("person_key"))


def classified(spark, sf_dir, model, params):
    from quintil.operators.classify import classification_report, roc_auc

    joined = splits.with_split(labelled(spark, sf_dir))
    fitted = models.fit_model(joined.filter(F.col("split") == "train"), CLASS_FEATURES, "INGRESO", model, params)
    test = fitted.transform(joined.filter(F.col("split") == "test")).select("INGRESO", "y_pred", "score").persist()
    report = classification_report(test.withColumn("y_pred", F.col("y_pred").cast("int")), "INGRESO", "y_pred")
    return report.withColumn("auc", F.lit(roc_auc(test, "INGRESO", "score").first()["auc"]))


@query("j11_logistic")
def j11(spark, sf_dir):
    return classified(spark, sf_dir, "logistic", {"penalty": "l2", "C": 10, "max_iter": 20})


@query("j9_random_forest_classifier")
def j9c(spark, sf_dir):
    return classified(spark, sf_dir, "random_forest_classifier", {"n_estimators": 10, "max_depth": 5})


@query("j12_boosted_classifier")
def j12(spark, sf_dir):
    return classified(spark, sf_dir, "boosted_classifier", {"max_iter": 5, "max_depth": 3, "subsample": 0.75, "colsample": "0.75"})


@query("j13_linear_svm")
def j13(spark, sf_dir):
    return classified(spark, sf_dir, "linear_svm", {"C": 1, "max_iter": 20})


@query("j14_knn_classify", """WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY md5('42:' || vec_id)) - 1 AS pos, count(*) OVER () AS n FROM embeddings),
  s AS (SELECT e.*, CASE WHEN pos < round_even(n * CAST(0.7 AS DOUBLE), 0) THEN 'train' WHEN pos < round_even(n * CAST(0.7 AS DOUBLE), 0) + round_even(n * CAST(0.2 AS DOUBLE), 0) THEN 'test' ELSE 'validation' END AS split
    FROM r JOIN embeddings e USING (vec_id)),
  d AS (SELECT q.vec_id, q.label AS actual, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY
      list_sum(list_transform(list_zip(q.embedding, t.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2)), t.vec_id) AS k
    FROM s q JOIN s t ON q.split <> 'train' AND t.split = 'train' QUALIFY k <= 3),
  v AS (SELECT vec_id, actual, label, count(*) AS c FROM d GROUP BY ALL)
  SELECT vec_id, actual, label AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) = 1""")
def j14(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    joined = df.join(splits.random_split(df, "vec_id"), "vec_id")
    return neighbors.knn_classify(joined.filter(F.col("split") != "train"), joined.filter(F.col("split") == "train"), 3)


# --- composed runs --------------------------------------------------------------
@query("j24_run_experiment")
def j24(spark, sf_dir):
    from quintil.plans.experiment import Experiment, run_experiment

    df = people(spark, sf_dir)
    spec = Experiment(
        "baseline",
        {"linear_regression": {}, "ridge": {"alpha": [2.0, 5.0, 10.0]}, "lasso": {"alpha": [0.0025, 0.005, 0.0075]},
         "hist_gradient_boosting": {"max_iter": [5], "learning_rate": [0.1], "max_leaf_nodes": [15], "min_samples_leaf": [15]}},
        categorical=["AGLOMERADO"],
    )
    run = run_experiment(spec, df, splits.random_split(df), "run_a")
    return tidy(run.comparison.drop("fit_time_seconds"))


@query("k7_geo_probe")
def k7(spark, sf_dir):
    from quintil.operators.explore import geo_rank, geo_rank_join
    from quintil.plans.experiment import Experiment, geo_probe

    df = people(spark, sf_dir)
    for area, name in (("AGLOMERADO", "AGLO_rk"), ("Region", "Reg_rk")):
        df = geo_rank_join(df, geo_rank(df, "ANO4", area, TARGET), ["ANO4", area], name)
    spec = Experiment("geo", {"ridge": {"alpha": [2.0]}}, categorical=["AGLOMERADO"])
    _, reading = geo_probe(spec, df, splits.random_split(df))
    return tidy(reading)
