"""Linear models on sparse rows against the matrix path and closed forms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_models import training_frame

from quintil.ml import design, linear, models
from quintil.ml.wide import SparseTraining


@pytest.mark.parametrize(
    ("model", "alpha", "ratio"), [("linear_regression", 0.0, 1.0), ("ridge", 3.0, 1.0), ("lasso", 0.02, 1.0), ("elastic_net", 0.05, 0.3)]
)
def test_sparse_rows_match_cross_products(spark, model, alpha, ratio):
    """Scores of folds with their own fills, scales and levels, weights and predictions."""
    df = spark.createDataFrame(training_frame()).repartition(3)
    left = linear.training_set(df, ["a", "b", "c"], "y", folds=3)
    right = linear.training_set(df, ["a", "b", "c"], "y", folds=3, matrix_levels=2)
    assert isinstance(left, linear.CrossProducts) and isinstance(right, SparseTraining)
    one, other = (linear.grid_search(p, model, [alpha], [ratio]) for p in (left, right))
    # Without a penalty, what a level adds that a fold's training set never saw is not determined.
    scores = slice(6, 7) if model == "linear_regression" else slice(4, 7)
    np.testing.assert_allclose(other.rows[0][scores], one.rows[0][scores], atol=1e-6)
    assert other.best_params == one.best_params
    assert [n for n, _ in other.fit.coefficients()] == [n for n, _ in one.fit.coefficients()]
    if model != "linear_regression":  # without a penalty, weights of all levels are not unique
        np.testing.assert_allclose([w for _, w in other.fit.coefficients()], [w for _, w in one.fit.coefficients()], atol=1e-5)
    new = spark.createDataFrame([(None, 2.0, "x"), (4.0, None, "unseen"), (1.0, 1.0, None)], "a double, b double, c string")
    scored = [[r["y_pred"] for r in p.fit.transform(new).collect()] for p in (one, other)]
    # An unseen level has no weight, so it is told by the intercept, unique with a penalty only.
    rows = [0, 2] if model == "linear_regression" else [0, 1, 2]
    np.testing.assert_allclose([scored[1][i] for i in rows], [scored[0][i] for i in rows], atol=1e-5)
    assert other.fit.transform(new).columns == ["a", "b", "c", "y_pred"]
    right.close()


def test_dropped_level_and_path(spark):
    df = spark.createDataFrame(training_frame())
    left = linear.cross_products(df, ["a", "c"], "y", 3)
    right = SparseTraining(df, ["a", "c"], "y", 3)
    for held in (-1, 0, 2):
        (one, *scores), (other, *others) = left.fit(held, 2.0, None, ["c"]), right.fit(held, 2.0, None, ["c"])
        assert all(math.isclose(a, b, abs_tol=1e-6) for a, b in zip(scores, others) if a is not None)
        known = dict(other.coefficients())
        assert all(math.isclose(w, known[n], abs_tol=1e-5) for n, w in one.coefficients())
    paths = [linear.regularization_path(spark, p, "lasso", [0.01, 0.1]).drop("mean_fit_time").toPandas() for p in (left, right)]
    pd.testing.assert_frame_equal(*paths, atol=1e-5)
    right.close()


def test_ten_thousand_levels(spark):
    """One set of levels under ridge has a closed form."""
    levels, rows, alpha = 10_000, 40_000, 5.0
    df = spark.range(rows).select(
        F.col("id").alias("row_id"), F.concat(F.lit("v"), F.pmod(F.xxhash64("id"), F.lit(levels))).alias("c"), (F.pmod(F.hash("id"), F.lit(1000)) / 100).alias("y")
    )
    data = linear.training_set(df, ["c"], "y", matrix_levels=linear.MATRIX_LEVELS)
    assert isinstance(data, SparseTraining)
    fit, r2, _ = data.fit(-1, alpha)
    data.close()
    g = df.toPandas().groupby("c")["y"].agg(["count", "mean"]).sort_index()
    share = g["count"] / (g["count"] + alpha)
    b = (share * g["mean"]).sum() / share.sum()
    assert math.isclose(fit.model.intercept, b, abs_tol=1e-5)
    assert [n for n, _ in fit.coefficients()] == [f"cat__c_{v}" for v in g.index]
    np.testing.assert_allclose([w for _, w in fit.coefficients()], share * (g["mean"] - b), atol=1e-4)
    assert 0 < r2 < 1
    counted = {r["feature"]: r["n"] for r in design.one_hot_counts(df, ["c"]).collect()}
    assert counted == {f"cat__c_{v}": n for v, n in g["count"].items()}


def test_trees_and_classifiers_take_many_levels(spark):
    """No matrix is built, so levels are not bounded; products of all slots still are."""
    df = spark.range(6_000).select(F.concat(F.lit("v"), F.col("id") % 5_000).alias("c"), (F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 2 * 3.0).alias("x"))
    fit = models.fit_model(df, ["c", "x"], "y", "logistic", {"penalty": "l2", "C": 1.0})
    scored = fit.transform(df.limit(200)).select("y", "y_pred").toPandas()
    assert (scored["y"] == scored["y_pred"]).all()
    with pytest.raises(ValueError, match="more than 4000 levels"):
        models.fit_model(df, ["c", "x"], "y", "polynomial_lasso", {"alpha": 0.1})
