import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quintil.functions.quantiles import exact_percentiles
from quintil.functions.scalar import with_errors
from quintil.operators import classify, explore, metrics
from quintil.plans.diagnostics import build_diagnostics


@pytest.mark.parametrize("bins", [8, 4096])
def test_percentiles_match_numpy(spark, bins):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=3000), np.zeros(1500), rng.integers(0, 5, 500)])
    pdf = pd.DataFrame({"g": np.where(np.arange(5000) < 4200, "hot", None), "x": values, "y": -values})
    df = spark.createDataFrame(pdf, "g string, x double, y double").repartition(5)
    probs = [0.0, 0.05, 0.25, 0.5, 0.77, 0.95, 1.0]
    got = exact_percentiles(df, ["x", "y"], probs, ["g"], bins=bins).collect()
    assert len(got) == 4
    for r in got:
        part = pdf[pdf.g.isna()] if r["g"] is None else pdf[pdf.g == r["g"]]
        assert r["n"] == len(part)
        np.testing.assert_allclose(r["q"], np.quantile(part[r["variable"]], probs), atol=1e-12)


def test_percentiles_of_extreme_values(spark):
    values = [-1.7e308, -1e300, -1e12, -1e12 + 1, -0.0, 0.0, 5e-324, 1e-323, 1e-300, 1.0, 1.0 + 2**-52, 1.0 + 2**-51, 3e7, 1.6e308, 1.7e308]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (math.nan,)], "v double")
    probs = [i / 14 for i in range(15)]
    row = exact_percentiles(df, ["v"], probs).first()
    assert row["n"] == 15 and all(a == b or math.isclose(a, b, rel_tol=1e-9) for a, b in zip(row["q"], values))
    assert exact_percentiles(spark.createDataFrame([(math.inf,), (2.0,), (-math.inf,)], "v double"), ["v"], [0.0, 0.5, 1.0]).first()["q"] == [-math.inf, 2.0, math.inf]
    assert exact_percentiles(df.where("v is null"), ["v"], [0.5]).count() == 0


@pytest.mark.parametrize("shape", ["plain", "ties", "constant", "few"])
def test_deciles_match_qcut(spark, shape):
    rng = np.random.default_rng(3)
    y = {"plain": rng.normal(size=997), "ties": np.where(rng.random(800) < 0.6, 0.0, rng.normal(size=800)), "constant": np.ones(20), "few": np.array([1.0, 2.0, 3.0])}[shape]
    df = spark.createDataFrame([("r", "m", "test", i, float(v)) for i, v in enumerate(y)], "run_id string, model string, split string, row_id long, y_true double")
    got = [r["income_decile"] for r in metrics.income_decile(df).orderBy("row_id").collect()]
    if shape == "constant":
        assert got == [None] * 20
    else:
        want = pd.qcut(pd.Series(y), 10, labels=False, duplicates="drop") + 1
        assert got == want.tolist()


def predictions(spark):
    """Two models on 2 x 20 rows; the second one is closer on every row."""
    rows = []
    for model, step in (("LinearRegression", 0.20), ("Ridge", 0.05)):
        for split in ("test", "validation"):
            for i in range(20):
                y = 3.0 + i * 0.1
                rows.append(("run_a", model, split, i, y, y + (step if i % 2 else -step)))
    df = spark.createDataFrame(rows, "run_id string, model string, split string, row_id long, y_true double, y_pred double")
    return metrics.predictions_table(df)


def test_diagnostic_tables(spark):
    stored = predictions(spark)
    pairs = metrics.pairwise_errors(stored).collect()
    assert [(r["model_a"], r["model_b"], r["n_common_rows"], r["share_rows_b_better"], r["share_rows_tied"]) for r in pairs] == [("LinearRegression", "Ridge", 20, 1.0, 0.0)] * 2
    summary = {(r["model"], r["split"]): r for r in metrics.residual_summary(stored).collect()}
    pdf = stored.toPandas()
    part = pdf[(pdf.model == "Ridge") & (pdf.split == "test")]
    row = summary[("Ridge", "test")]
    assert math.isclose(row["residual_std"], part.residual.std(), abs_tol=1e-12)
    assert math.isclose(row["residual_p05"], part.residual.quantile(0.05), abs_tol=1e-12)
    assert math.isclose(row["r2"], 1 - (part.squared_error.sum() / ((part.y_true - part.y_true.mean()) ** 2).sum()), abs_tol=1e-12)
    deciles = metrics.error_by_decile(stored).filter("model = 'Ridge' and split = 'test'").orderBy("income_decile").collect()
    assert [r["n"] for r in deciles] == [2] * 10


def test_repeated_prediction_fails(spark):
    stored = predictions(spark)
    with pytest.raises(PySparkException, match="Duplicate prediction"):
        metrics.pairwise_errors(stored.union(stored.limit(1))).collect()


def test_gaps_long_and_best(spark):
    df = spark.createDataFrame(
        [("LinearRegression", 0.70, 0.2, 0.68, 0.21), ("Ridge", 0.90, 0.1, 0.91, 0.09)],
        "model string, test_r2 double, test_mae double, validation_r2 double, validation_mae double",
    )
    gaps = {(r["model"], r["metric"]): r["validation_minus_test"] for r in metrics.metric_gaps(df, "run_a").collect()}
    assert math.isclose(gaps[("LinearRegression", "r2")], -0.02) and math.isclose(gaps[("Ridge", "r2")], 0.01)
    assert metrics.metrics_long(df, "run_a").count() == 8


def test_build_diagnostics_covers_everything(spark):
    stored = predictions(spark)
    before = stored.orderBy("model", "split", "row_id").collect()
    comparison = metrics.model_comparison(stored)
    tables = build_diagnostics(stored, comparison, "run_a")
    assert {"residual_summary", "error_by_income_decile", "pairwise_error_comparison", "metric_gaps", "decile_curves", "observed_vs_predicted", "notes"} <= set(tables)
    assert sum(r["n"] for r in tables["observed_vs_predicted"].collect()) == 20
    assert tables["notes"].filter("status = 'skipped'").count() == 1
    assert stored.orderBy("model", "split", "row_id").collect() == before
    with pytest.raises(ValueError, match="Available splits"):
        build_diagnostics(stored, comparison, "run_a", split="holdout")


def test_constant_group_has_no_r2(spark):
    df = with_errors(spark.createDataFrame([("m", 1.0, 1.5), ("m", 1.0, 0.5)], "model string, y_true double, y_pred double"))
    assert metrics.model_summary(df).first()["r2"] is None


def test_feature_counts_must_agree(spark):
    df = spark.createDataFrame([("a", 3), ("b", 4)], "model string, feature_count int")
    with pytest.raises(ValueError):
        metrics.require_feature_count_consistency(df)
    metrics.require_feature_count_consistency(df.limit(1))


def test_bias_interval(spark):
    df = spark.createDataFrame([("m", 100, 0.5, 4.0, 2.0, 0.0)], "model string, n long, error double, error_var double, var_pred double, var_real double")
    row = metrics.bias_ci(df).first()
    assert math.isclose(row["ci95"], 1.96 * 2 / 10) and row["significant"] and row["var_ratio"] is None


def test_auc_and_report(spark):
    rng = np.random.default_rng(5)
    score, label = np.round(rng.random(400), 1), rng.integers(0, 2, 400)
    df = spark.createDataFrame([(int(a), float(b), int(b > 0.5)) for a, b in zip(label, score)], "label int, score double, prediction int")
    pos, neg = score[label == 1], score[label == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert math.isclose(classify.roc_auc(df).first()["auc"], want)
    report = {r["class"]: r for r in classify.classification_report(df).collect()}
    guess = (score > 0.5).astype(int)
    assert math.isclose(report[1]["precision"], (label[guess == 1] == 1).mean())
    assert math.isclose(report[0]["recall"], (guess[label == 0] == 0).mean())
    assert math.isclose(report[0]["accuracy"], (guess == label).mean())


def test_exploration_matches_pandas(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": rng.integers(0, 6, 300).astype(float), "b": rng.normal(size=300), "c": rng.normal(size=300)})
    pdf["c"] += pdf["a"]
    df = spark.createDataFrame(pdf)
    got = {(r["variable_1"], r["variable_2"]): r["correlation"] for r in explore.spearman_pairs(df, ["a", "b", "c"]).collect()}
    want = pdf.rank().corr().abs()
    for (x, y), value in got.items():
        assert math.isclose(value, want.loc[x, y], abs_tol=1e-9)
    counts, edges = np.histogram(pdf["b"], bins=10)
    bins = {r["bin"]: r["n"] for r in explore.histogram(df, ["b"], 10).collect()}
    assert [bins.get(i, 0) for i in range(10)] == counts.tolist()
    assert sum(r["n"] for r in explore.density_2d(df, "b", "c", 5).collect()) == 300


def test_determinism_and_ranks(spark):
    df = spark.createDataFrame([("x", "1", "p"), ("x", "1", "q"), ("y", "2", "p"), ("y", "2", None)], "a string, b string, c string")
    scores = {(r["A"], r["B"]): (r["pmax_B_given_A"], r["pmax_A_given_B"]) for r in explore.determinism_scores(df, ["a", "b", "c"]).collect()}
    assert scores[("a", "b")] == (1.0, 1.0) and scores[("a", "c")] == (0.5, 0.75)
    assert [(r["A"], r["B"]) for r in explore.near_deterministic_pairs(df, ["a", "b", "c"]).collect()] == [("a", "b")]
    income = spark.createDataFrame([(2003, r, float(i)) for i, r in enumerate("abcdef")], "ANO4 int, Region string, P47T double")
    assert sorted(r["rank"] for r in explore.geo_rank(income, "ANO4", "Region").collect()) == [0.167, 0.333, 0.5, 0.667, 0.833, 1.0]


def test_spearman_ranks_pairs_on_common_rows(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({c: np.where(rng.random(60) < 0.3, np.nan, rng.integers(0, 9, 60)) for c in "abc"})
    frame["d"] = rng.integers(0, 5, 60).astype(float)
    df = spark.createDataFrame(frame).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in frame])
    got = {(r.variable_1, r.variable_2): r.correlation for r in explore.spearman_pairs(df, list("abcd")).collect()}
    want = frame.corr("spearman").abs()
    assert all(abs(got[a, b] - want.loc[a, b]) < 1e-9 for a, b in got) and len(got) == 6


def test_density_leaves_nulls_out(spark):
    df = spark.createDataFrame([(0.5, None), (0.0, 0.0), (1.0, 1.0), (None, 1.0)], "x double, y double")
    assert sum(r["n"] for r in explore.density_2d(df, "x", "y", 2).collect()) == 2


def test_average_ranks_over_partition_edges(spark):
    from quintil.operators.order import average_rank_of_rows

    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"grp": rng.integers(0, 3, 900), "value": np.where(rng.random(900) < 0.5, 2.0, rng.integers(0, 40, 900)), "row": np.arange(900)})
    pdf.loc[pdf.grp == 1, "value"] = 7.0
    df = spark.createDataFrame(pdf, "grp int, value double, row long").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = average_rank_of_rows(df).orderBy("row").toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert (got.avg_rank == pdf.groupby("grp").value.rank()).all()
    assert average_rank_of_rows(df.where("grp > 5")).count() == 0
