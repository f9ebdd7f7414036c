import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quintil.ml import design, importance, linear, models, neighbors
from quintil.operators import selection, splits


def training_frame(rows=240, seed=0):
    """Two numeric columns with holes, a rare level and a missing level."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"row_id": np.arange(rows), "a": rng.normal(5, 2, rows), "b": rng.integers(0, 7, rows).astype(float)})
    pdf["c"] = rng.choice(["x", "y", "z"], rows, p=[0.5, 0.3, 0.2])
    pdf["y"] = 1.5 + 0.4 * pdf.a - 0.2 * pdf.b + pdf.c.map({"x": 0.0, "y": 0.7, "z": -0.4}) + rng.normal(0, 0.3, rows)
    pdf.loc[rng.random(rows) < 0.1, "a"] = np.nan
    pdf.loc[rng.random(rows) < 0.05, "c"] = None
    pdf.loc[rows - 1, "c"] = "only_in_last_fold"
    return pdf


def brute_design(train, other):
    """Imputed, scaled and one-hot encoded matrices fitted on ``train``."""
    blocks_train, blocks_other = [], []
    for c in ("a", "b"):
        median = train[c].median()
        left, right = train[c].fillna(median), other[c].fillna(median)
        mean, std = left.mean(), left.std(ddof=0)
        blocks_train.append(((left - mean) / std).to_numpy()[:, None])
        blocks_other.append(((right - mean) / std).to_numpy()[:, None])
    counts = train["c"].value_counts()
    mode = sorted(counts[counts == counts.max()].index)[0]
    levels = sorted(train["c"].dropna().unique())
    for block, frame in ((blocks_train, train), (blocks_other, other)):
        filled = frame["c"].fillna(mode)
        block.append(np.column_stack([(filled == v).astype(float) for v in levels]))
    return np.hstack(blocks_train), np.hstack(blocks_other)


def brute_fit(x, y, alpha, l1):
    xm, ym = x.mean(axis=0), y.mean()
    xc, yc = x - xm, y - ym
    if alpha == 0:
        w = np.linalg.pinv(xc) @ yc
    elif not l1:
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    else:
        w, n = np.zeros(x.shape[1]), len(y)
        for _ in range(5000):
            for j in range(len(w)):
                r = yc - xc @ w + xc[:, j] * w[j]
                rho = xc[:, j] @ r / n
                w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / max(xc[:, j] @ xc[:, j] / n, 1e-12)
    return w, ym - xm @ w


def r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize(("model", "alpha"), [("linear_regression", 0.0), ("ridge", 3.0), ("lasso", 0.02)])
def test_grid_search_matches_brute_force(spark, model, alpha):
    """Per-fold imputation, scaling, encoding and scores from cross-products."""
    pdf = training_frame()
    products = linear.cross_products(spark.createDataFrame(pdf).repartition(3), ["a", "b", "c"], "y", folds=3)
    result = linear.grid_search(products, model, [alpha])
    tests, trains = [], []
    for block in np.array_split(np.arange(len(pdf)), 3):
        train, held = pdf.drop(index=block), pdf.loc[block]
        x, z = brute_design(train, held)
        w, b = brute_fit(x, train["y"].to_numpy(), alpha, model == "lasso")
        tests.append(r2(held["y"].to_numpy(), z @ w + b))
        trains.append(r2(train["y"].to_numpy(), x @ w + b))
    assert math.isclose(result.best_score, np.mean(tests), abs_tol=1e-7)
    assert math.isclose(result.best_std, np.std(tests), abs_tol=1e-7)
    assert math.isclose(result.rows[0][6], np.mean(trains), abs_tol=1e-7)
    x, _ = brute_design(pdf, pdf)
    w, b = brute_fit(x, pdf["y"].to_numpy(), alpha, model == "lasso")
    scored = spark.createDataFrame(pdf).select("row_id", result.fit.predict_column().alias("p")).orderBy("row_id").toPandas()
    np.testing.assert_allclose(scored["p"], x @ w + b, atol=1e-6)
    np.testing.assert_allclose([c for _, c in result.fit.coefficients()], w, atol=1e-6)


def test_regularization_path_shrinks(spark):
    products = linear.cross_products(spark.createDataFrame(training_frame()), ["a", "b", "c"], "y", folds=3)
    ridge = linear.regularization_path(spark, products, "ridge", [0.1, 1.0, 10.0, 1.0]).collect()
    assert [r["alpha"] for r in ridge] == [0.1, 1.0, 10.0]
    assert ridge[0]["coefficient_l2_norm"] > ridge[2]["coefficient_l2_norm"]
    lasso = linear.regularization_path(spark, products, "lasso", [0.001, 0.01, 0.1]).collect()
    assert lasso[0]["nonzero_coefficients"] >= lasso[2]["nonzero_coefficients"]
    best = linear.grid_search(products, "ridge", [0.1, 1.0, 10.0])
    assert sorted(r[-1] for r in best.rows) == [1, 2, 3]


def test_drop_first_gives_the_same_predictions(spark):
    products = linear.cross_products(spark.createDataFrame(training_frame()), ["a", "c"], "y")
    full, full_r2, _ = linear.fit_view(products, -1)
    less, less_r2, _ = linear.fit_view(products, -1, drop_first=["c"])
    assert math.isclose(full_r2, less_r2, abs_tol=1e-9)
    assert len(less.categorical["c"]) == len(full.categorical["c"]) - 1


def test_constant_and_all_missing_columns(spark):
    pdf = training_frame(60)
    pdf["k"], pdf["m"] = 3.0, None
    df = spark.createDataFrame(pdf.assign(m=pdf["m"].astype("float64")))
    products = linear.cross_products(df, ["a", "k", "m"], "y", folds=3)
    assert math.isfinite(linear.grid_search(products, "ridge", [1.0]).best_score)


def test_level_bound(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="more than 10 levels"):
        design.level_table(df, ["c"], max_levels=10)


def test_assembled_vector(spark):
    train = spark.createDataFrame([(1.0, "u"), (None, "v"), (3.0, None), (5.0, "v")], "x double, c string")
    prepared = design.prepare(train, ["x", "c"])
    assert prepared.names() == ["num__x", "cat__c_u", "cat__c_v"]
    other = spark.createDataFrame([(None, "new"), (2.0, None)], "x double, c string")
    vectors = [r[0].toArray().tolist() for r in prepared.assemble(other).select("features").collect()]
    assert vectors == [[3.0, 0.0, 0.0], [2.0, 0.0, 1.0]]


def step_frame(spark, rows=600):
    """A target with a threshold and an interaction, which a line cannot follow."""
    x = (F.hash("id") % 100 + 100) % 100
    z = (F.hash(F.col("id") + 9999) % 100 + 100) % 100
    df = spark.range(rows).select(F.col("id").alias("row_id"), x.cast("double").alias("x"), z.cast("double").alias("z"))
    return df.withColumn("y", F.when((F.col("x") > 50) != (F.col("z") > 50), 2.0).otherwise(0.0))


def test_boosting_beats_a_line(spark):
    df = step_frame(spark)
    joined = df.join(splits.random_split(df), "row_id")
    train, test = joined.filter("split = 'train'"), joined.filter("split = 'test'")
    line = linear.grid_search(linear.cross_products(train, ["x", "z"], "y", 3), "linear_regression")
    search = models.grid_search(train, ["x", "z"], "y", "hist_gradient_boosting", {"max_iter": [2, 10], "max_depth": [3], "min_samples_leaf": [5]}, folds=3)
    assert search.best_score > line.best_score + 0.2 and search.best_params["max_iter"] == 10
    frame = models.search_frame(spark, search, "HistGradientBoostingRegressor")
    assert sorted(r["rank_test_score"] for r in frame.collect()) == [1, 2]
    stages = models.staged_scores(search.fit, train, test, "y", every=2).orderBy("iteration").collect()
    scores = [r["train_r2"] for r in stages]
    assert scores == sorted(scores) and sum(r["best"] for r in stages) == 1


@pytest.mark.parametrize("model", ["logistic", "random_forest_classifier", "boosted_classifier", "linear_svm"])
def test_classifiers_learn(spark, model):
    df = step_frame(spark, 300).withColumn("label", (F.col("x") > 40).cast("int"))
    params = {"logistic": {"penalty": "l1", "C": 10}, "boosted_classifier": {"max_iter": 3}, "linear_svm": {"C": 10, "max_iter": 20}}.get(model, {"n_estimators": 5})
    fitted = models.fit_model(df, ["x", "z"], "label", model, params)
    assert fitted.transform(df).agg(F.avg((F.col("y_pred") == F.col("label")).cast("double"))).first()[0] > 0.9


def test_other_regressors(spark):
    df = step_frame(spark, 300)
    for model, params in (("random_forest", {"n_estimators": 5}), ("polynomial_lasso", {"alpha": 0.01})):
        fitted = models.fit_model(df, ["x", "z"], "y", model, params)
        assert fitted.transform(df).filter("y_pred is null").isEmpty()
    with pytest.raises(ValueError, match="Unsupported"):
        models.fit_model(df, ["x"], "y", "mlp")


@pytest.mark.parametrize("clustered", [True, False])
def test_neighbours_match_brute_force(spark, clustered):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(300, 6)) + (rng.integers(0, 4, 300)[:, None] * 20 if clustered else 0)
    label = rng.integers(0, 3, 300)
    df = spark.createDataFrame([(i, p.tolist(), int(c)) for i, (p, c) in enumerate(zip(points, label))], "vec_id long, embedding array<double>, label int")
    got = neighbors.nearest_neighbors(df.filter("vec_id % 5 = 0"), df.filter("vec_id % 5 <> 0"), 3, pivots=8, block_rows=40).collect()
    found = {}
    for r in got:
        found.setdefault(r["query"], {})[r["position"]] = r["neighbor"]
    refs = np.array([i for i in range(300) if i % 5])
    for q in range(0, 300, 5):
        away = ((points[refs] - points[q]) ** 2).sum(axis=1)
        assert [found[q][k] for k in (1, 2, 3)] == refs[np.argsort(away)[:3]].tolist()


def test_importance_paths_agree(spark):
    """The linear shortcut equals permuting the frame and predicting again."""
    pdf = training_frame(120).fillna({"a": 5.0, "c": "x"})
    df = spark.createDataFrame(pdf)
    fit, _, _ = linear.fit_view(linear.cross_products(df, ["a", "b", "c"], "y"), -1)
    blocks = {"AC": ["a", "c", "absent"]}
    fast = {r["feature_or_group"]: r for r in importance.linear_importance(fit, df, "y", blocks, ["a", "b", "c"], repeats=2).collect()}
    slow = importance.permutation_importance(lambda d: d.withColumn("y_pred", fit.predict_column()), df, "y", blocks, ["a", "b", "c"], repeats=2)
    assert set(fast) == {"AC", "b"} and fast["AC"]["n_cols"] == 2
    for r in slow.collect():
        other = fast[r["feature_or_group"]]
        for name in ("importance_mean", "importance_std", "imp_mae_mean", "base_score"):
            assert math.isclose(r[name], other[name], abs_tol=1e-9)
    top = selection.top_k(slow.withColumn("model", F.lit("m")), "importance_mean", 1).collect()
    assert [r["feature_or_group"] for r in top] == ["AC"]


def test_univariate_screen(spark):
    df = spark.createDataFrame(training_frame(200))
    joined = df.join(splits.random_split(df), "row_id")
    screen = models.univariate_screen(joined, ["a", "c"], "y", {"polynomial_lasso": {"alpha": 0.01}, "random_forest": {"n_estimators": 3}}, ["c"])
    rows = screen.collect()
    assert len(rows) == 3
    best = {r["column"]: r for r in selection.best_per_column(screen).collect()}
    assert sum(r["overall"] for r in best.values()) == 1
    lines = {r["column"]: r for r in models.univariate_lines(joined, ["a", "b"], "y").collect()}
    pdf = joined.filter("split = 'train'").toPandas().dropna(subset=["a"])
    assert math.isclose(lines["a"]["slope"], np.polyfit(pdf.a, pdf.y, 1)[0], abs_tol=1e-9)


def test_parameters_without_effect_are_refused():
    with pytest.raises(ValueError, match="alpha"):
        models.refuse_ignored("hist_gradient_boosting", {"alpha": 0.1})
    models.refuse_ignored("hist_gradient_boosting", {"alpha": 0.0, "l2_regularization": 0.1, "early_stopping": True})


def test_descent_reaches_its_end_or_fails():
    from quintil.ml import linear

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    x[:, 3] = x[:, 0] + 1e-3 * rng.normal(size=200)
    y = x @ [1.0, 0.5, 0.0, 0.0]
    w = linear._solve(x.T @ x, x.T @ y, 200, 0.01, 1.0)
    slope = x.T @ (y - x @ w) / 200
    assert np.all(np.abs(slope) <= 0.01 + 1e-9)
