import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quintil.ml import boosting, models
from quintil.ml.boosting import Settings


def frame(rows=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, rows).astype(float)
    z = np.round(rng.normal(size=rows), 2)
    c = rng.choice(list("uvwst"), rows)
    y = np.where(x > 6, 2.0, 0.0) * (z > 0) + (c == "v") * 1.5 + rng.normal(size=rows) * 0.1
    pdf = pd.DataFrame({"row_id": np.arange(rows), "x": x, "z": z, "c": c, "y": y, "flag": (y > 1).astype(int)})
    pdf.loc[5, "x"] = np.nan
    pdf.loc[7, "c"] = None
    return pdf


def sides(pdf):
    """Every split of the table: (name, rows that go left), in order of features and bins."""
    x, z = pdf.x.fillna(pdf.x.median()), pdf.z
    found = []
    for name, v in (("x", x), ("z", z)):
        distinct = np.unique(v)
        cuts = (distinct[1:] + distinct[:-1]) / 2
        found += [(name, (v <= t).to_numpy()) for t in cuts]
    c = pdf.c.fillna(pdf.c.mode().min())
    return found + [("c", (c == level).to_numpy()) for level in sorted(c.unique())]


def slow_boost(pdf, target, s):
    """The same trees, one split at a time over all splits."""
    y = pdf[target].to_numpy(float)
    raw = np.full(len(y), y.mean() if s.loss == "squared" else np.log(y.mean() / (1 - y.mean())))
    splits = sides(pdf)
    for _ in range(s.max_iter):
        if s.loss == "squared":
            g, h = raw - y, np.ones(len(y))
        else:
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
        leaves = [(np.ones(len(y), bool), 0)]
        while len(leaves) < (s.max_leaf_nodes or 10**9):
            best = None
            for i, (rows, depth) in enumerate(leaves):
                if s.max_depth is not None and depth >= s.max_depth:
                    continue
                before = g[rows].sum() ** 2 / (h[rows].sum() + s.l2_regularization)
                for name, left in splits:
                    a, b = rows & left, rows & ~left
                    if min(a.sum(), b.sum()) < s.min_samples_leaf or min(h[a].sum(), h[b].sum()) < 1e-3:
                        continue
                    gain = sum(g[q].sum() ** 2 / (h[q].sum() + s.l2_regularization) for q in (a, b)) - before
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, i, a, b, depth + 1)
            if best is None:
                break
            leaves = [x for i, x in enumerate(leaves) if i != best[1]] + [(best[2], best[4]), (best[3], best[4])]
        for rows, _ in leaves:
            raw[rows] -= s.learning_rate * g[rows].sum() / (h[rows].sum() + s.l2_regularization)
    return raw


@pytest.mark.parametrize(
    ("target", "settings"),
    [
        ("y", Settings(max_iter=3, max_leaf_nodes=6, min_samples_leaf=5)),
        ("y", Settings(max_iter=2, max_leaf_nodes=2, min_samples_leaf=1, learning_rate=1.0, l2_regularization=30.0)),
        ("y", Settings(max_iter=12, max_leaf_nodes=4, min_samples_leaf=20, l2_regularization=2.0)),
        ("y", Settings(max_iter=2, max_leaf_nodes=None, max_depth=2, min_samples_leaf=3)),
        ("flag", Settings(max_iter=3, max_leaf_nodes=5, min_samples_leaf=5, loss="log", l2_regularization=1.0)),
    ],
)
def test_trees_are_those_of_single_steps(spark, target, settings):
    pdf = frame()
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None))).repartition(3)
    booster = boosting.fit(df, ["x", "z", "c"], target, settings)
    got = booster.transform(df).orderBy("row_id").toPandas()
    want = slow_boost(pdf, target, settings)
    if settings.loss == "log":
        np.testing.assert_allclose(got.score, 1 / (1 + np.exp(-want)), atol=1e-8)
        assert ((want > 0) == (got.y_pred == 1)).all()
    else:
        np.testing.assert_allclose(got.y_pred, want, atol=1e-8)
    assert all((t.feature < 0).sum() <= (settings.max_leaf_nodes or 4) + sum(t.feature >= 0) for t in booster.trees)


def test_penalty_changes_the_fit(spark):
    df = spark.createDataFrame(frame()).withColumn("x", F.nanvl("x", F.lit(None)))
    search = models.grid_search(
        df, ["x", "z"], "y", "hist_gradient_boosting",
        {"max_iter": [3], "max_leaf_nodes": [4], "min_samples_leaf": [5], "l2_regularization": [0.0, 20.0, 500.0], "early_stopping": [False]}, folds=2,
    )
    scores = [r["mean_test_score"] for r in search.rows]
    assert scores[0] > scores[1] > scores[2] and search.best_params["l2_regularization"] == 0.0


def test_early_stopping_ends_before_the_last_tree(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=800), "y": rng.normal(size=800)}))
    settings = Settings(max_iter=40, learning_rate=0.5, early_stopping=True, n_iter_no_change=3, validation_fraction=0.3, min_samples_leaf=5)
    booster = boosting.fit(df, ["x"], "y", settings)
    assert 3 <= len(booster.trees) < 40
    held = [loss[1] for loss in booster.losses]
    assert min(held[-3:]) >= held[-4] - settings.tol
    assert boosting.held_share(df, Settings(early_stopping="auto")) == 0.0


def test_many_levels_and_many_bins(spark):
    levels = 5000
    df = spark.range(4 * levels).select(
        F.concat(F.lit("level "), (F.col("id") % levels).cast("string")).alias("c"), F.col("id").cast("double").alias("x"),
        F.when(F.col("id") % levels == 4321, 10.0).otherwise(0.0).alias("y"),
    )
    booster = boosting.fit(df, ["c", "x"], "y", Settings(max_iter=1, max_leaf_nodes=2, min_samples_leaf=1, learning_rate=1.0))
    found = booster.transform(df).groupBy("c").agg(F.avg("y_pred").alias("p")).where("p > 5").collect()
    assert [r.c for r in found] == ["level 4321"]
    assert len(booster.encoder.edges[0]) <= boosting.MAX_BINS
    unknown = spark.createDataFrame([("new", 1.0, None), (None, None, None)], "c string, x double, y double")
    assert booster.transform(unknown).where("y_pred is null").isEmpty()


def test_sampled_rows_and_columns_repeat(spark):
    df = spark.createDataFrame(frame()).withColumn("x", F.nanvl("x", F.lit(None))).repartition(2)
    params = {"max_iter": 4, "max_depth": 2, "subsample": 0.6, "colsample": "0.5"}
    first, second = (models.fit_model(df, ["x", "z", "c"], "flag", "boosted_classifier", params).booster for _ in range(2))
    assert [t.feature.tolist() for t in first.trees] == [t.feature.tolist() for t in second.trees]
    assert len({int(f) for t in first.trees for f in t.feature if f >= 0}) > 1


def test_odd_tables(spark):
    flat = spark.createDataFrame([(1.0, 3.0)] * 30, "x double, y double")
    assert boosting.fit(flat, ["x"], "y", Settings(max_iter=5)).trees == []
    empty = spark.createDataFrame([], "x double, c string, y double")
    assert boosting.fit(empty, ["x", "c"], "y", Settings(max_iter=5)).transform(empty).count() == 0
    with pytest.raises(ValueError, match="both classes"):
        boosting.fit(flat, ["x"], "y", Settings(loss="log"))
    with pytest.raises(ValueError, match="Unknown loss"):
        boosting.fit(flat, ["x"], "y", Settings(loss="huber"))
