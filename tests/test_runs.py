import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quintil.operators import metrics, selection, splits
from quintil.plans import compare
from quintil.plans.diagnostics import build_diagnostics, sweep_tables
from quintil.plans.experiment import Experiment, geo_probe, registry_manifests, run_experiment
from quintil.sources import annual, runs, tables


def people(spark, rows=90):
    """A small modelling table: y follows a number, a category and the year."""
    return spark.range(rows).select(
        F.col("id").alias("row_id"),
        (1 + 0.03 * (F.col("id") % 15) + 0.2 * (F.col("id") % 2) + 0.01 * F.floor(F.col("id") / 15)).alias("logP47T"),
        (2022 + F.floor(F.col("id") / 45)).cast("int").alias("ANO4"),
        (1 + F.floor(F.col("id") / 15) % 4).cast("int").alias("TRIMESTRE"),
        (F.col("id") % 15).cast("int").alias("feature_num"),
        F.when(F.col("id") % 2 == 0, "R0").otherwise("R1").alias("Region"),
        (F.col("id") % 3).cast("string").alias("AGLOMERADO"),
        (0.3 * (F.col("id") % 3)).alias("AGLO_rk"),
        F.when(F.col("id") % 2 == 0, 0.2).otherwise(0.8).alias("Reg_rk"),
    )


def spec(**kwargs):
    grid = {"linear_regression": {}, "ridge": {"alpha": [0.1, 1.0]}, "lasso": {"alpha": [0.001]}}
    return Experiment("exp", grid, folds=2, mode="debug", **kwargs)


def test_experiment_is_archived_and_compared(spark, tmp_path):
    df = people(spark)
    assignments = splits.random_split(df)
    registry = runs.RunRegistry(spark, str(tmp_path / "archive"))
    effect = [{"name": "region_fe", "columns": ["Region"], "max_levels": 5, "drop_first": True}]
    first = run_experiment(spec(fixed_effects=effect), df, assignments, "run_a", registry)
    second = run_experiment(spec(view={"name": "clean", "drop_columns": ["Region", "AGLO_rk", "Reg_rk"]}, sample_n=60), df, assignments, "run_b", registry)
    assert first.comparison.count() == 3 and second.facts["rows_used"] == 60
    assert first.facts["feature_count"] == 8 and second.facts["feature_count"] == 4
    levels = first.tables["fixed_effect_coefficients"].filter("model = 'Ridge'").orderBy("rank").collect()
    assert {r["level"] for r in levels} == {"R0", "R1"} and [r["rank"] for r in levels] == [1, 2]
    assert first.tables["regularization_path"].count() == 3
    assert first.tables["training_sample"].count() == 10
    ridge = first.comparison.filter("model = 'Ridge'").first()
    best = first.cv_results.filter("model = 'Ridge' and rank_test_score = 1").first()
    assert json.loads(ridge["best_params"])["alpha"] == best["param_reg__alpha"] and ridge["cv_r2_mean"] == best["mean_test_score"]
    assert registry.read("predictions", ["run_a"]).count() == first.predictions.count()
    with pytest.raises(ValueError, match="already archived"):
        run_experiment(spec(), df, assignments, "run_a", registry)
    manifests = registry_manifests(registry)
    stored = registry.read("metrics").withColumn("directory", F.concat(F.lit(registry.root + "/"), "run_id"))
    table = compare.compare_runs("cmp", stored, manifests)
    assert table.columns == list(compare.OUTPUT_COLUMNS) and table.count() == 6
    row = table.filter("run_id = 'run_a' and model = 'Ridge'").first()
    assert row["fixed_effects_summary"] == "region_fe(columns=Region, generated=fe_region_fe, n_levels=2, max_levels=5, drop_first=True)"
    assert table.filter("run_id = 'run_b'").first()["feature_view_summary"] == "name=clean; drop=Region,AGLO_rk,Reg_rk"


def test_experiment_needs_every_split(spark):
    df = people(spark, 20)
    marks = df.select("row_id", F.lit("train").alias("split"))
    with pytest.raises(ValueError, match="non-empty"):
        run_experiment(spec(), df, marks, "x")


def test_geo_probe_variants(spark):
    df = people(spark)
    scores, reading = geo_probe(Experiment("geo", {"ridge": {"alpha": [1.0]}}, folds=2), df, splits.random_split(df))
    assert {r["variant"] for r in scores.collect()} == {"with_geo_ranks", "clean_geo", "no_geo", "shuffled_geo_ranks"}
    assert reading.first()["geo_reading"] == "geography matters"


def write_run(root, run_id, manifest, card=None):
    folder = root / run_id
    folder.mkdir()
    (folder / runs.MANIFEST).write_text(json.dumps(manifest, indent=2))
    if card:
        (folder / runs.CARD).write_text(json.dumps(card))
    return str(folder)


def test_run_documents(spark, tmp_path):
    a = write_run(tmp_path, "run_a", {"run_id": "run_a", "experiment_id": "e", "mode": "debug", "rows_used": 30, "feature_count": 4, "run_dir": "/x/run_a"})
    b = write_run(tmp_path, "run_b", {"mode": "sweep"}, {"experiment_id": "from_card", "rows_used": 9, "feature_count": 5, "canonical_run_dir": "/y"})
    scores = spark.createDataFrame(
        [(a, "Ridge", 0.43, 0.2), (a, "Lasso", None, 0.3), (b, "Ridge", 0.41, 0.18)], "directory string, model string, validation_r2 double, validation_mae double"
    )
    table = compare.compare_runs("c", scores, runs.scan_run_docs(spark, [a, b]), runs.scan_run_docs(spark, [a, b], runs.CARD, required=False))
    rows = {(r["run_id"], r["model"]): r for r in table.collect()}
    assert rows[("run_b", "Ridge")]["experiment_id"] == "from_card" and rows[("run_b", "Ridge")]["feature_count"] == 5
    assert rows[("run_b", "Ridge")]["canonical_run_dir"] == "/y" and rows[("run_a", "Ridge")]["canonical_run_dir"] == "/x/run_a"
    assert [r["validation_r2"] for r in selection.comparison_order(table).collect()] == [0.43, 0.41, None]
    notes = {r["note"]: r["text"] for r in selection.best_notes(table).collect()}
    assert notes["best_validation_r2"] == "Best validation R2: 0.43 (run_a / Ridge)"
    assert notes["lowest_validation_mae"] == "Lowest validation MAE: 0.18 (run_b / Ridge)"
    assert notes["best_cv_r2"] == "Best CV R2: unavailable" and "4, 5" in notes["feature_count_warning"]
    with pytest.raises(FileNotFoundError):
        runs.scan_run_docs(spark, [str(tmp_path / "none")])
    (tmp_path / "run_a" / runs.MANIFEST).write_text("[1, 2")
    with pytest.raises(PySparkException, match="Not a JSON object"):
        runs.scan_run_docs(spark, [a]).collect()


def test_stored_tables(spark, tmp_path):
    rows = [("r", "m", s, i, 1.0 + i, 1.5 + i) for s in ("test", "validation") for i in range(20)]
    stored = metrics.predictions_table(spark.createDataFrame(rows, "run_id string, model string, split string, row_id long, y_true double, y_pred double"))
    path = str(tmp_path / "predictions")
    tables.sink_predictions(stored.filter("split = 'test'").drop("income_decile"), path)
    back = tables.scan_predictions(spark, path)
    assert back.count() == 20 and back.agg(F.max("income_decile")).first()[0] == 10
    with pytest.raises(FileNotFoundError):
        tables.scan_predictions(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="abs_error"):
        tables.sink_predictions(stored.drop("abs_error"), path)
    tables.sink_tables({"scores": stored.groupBy("split").count()}, str(tmp_path / "t"))
    assert tables.scan_metrics(spark, str(tmp_path / "t" / "scores.csv")).count() == 2
    assert tables.scan_cv_results(spark, str(tmp_path / "t"), "core").count() == 2
    assert tables.scan_cv_results(spark, str(tmp_path / "t"), "absent") is None


def test_fingerprint_ignores_layout(spark):
    df = people(spark)
    first = tables.table_fingerprint(df).first()
    assert tables.table_fingerprint(df.repartition(7).orderBy(F.desc("row_id"))).first() == first
    assert tables.table_fingerprint(df.withColumn("ANO4", F.when(F.col("row_id") == 3, 1999).otherwise(F.col("ANO4")))).first()["digest"] != first["digest"]


def test_annual_files_and_ranks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n5,6\n")
    (tmp_path / "b.csv").write_text("x\n7\n")
    frames, counts = annual.scan_annual(spark, {"2022": str(tmp_path / "a.csv"), "2023": str(tmp_path / "b.csv")})
    assert {tuple(r) for r in counts.collect()} == {("2022", 3, 2), ("2023", 1, 1)}
    limited, few = annual.scan_annual(spark, {"2022": str(tmp_path / "a.csv")}, "x int, y int", nrows=2)
    assert few.first()["rows"] == 2 and limited["2022"].count() == 2
    (tmp_path / "Reg").write_text("ANO4,Region,Reg_rk\n2003,Cuyo,0.5\n2003,Pampeana,0.667\n")
    assert annual.scan_geo_ranks(spark, str(tmp_path / "Reg"), "Region", "Reg_rk").agg(F.sum("Reg_rk")).first()[0] == pytest.approx(1.167)


def cv_sweep(spark):
    rows = [(0.05, 100, 31, 100, 0.0, 0.90, 0.8245, 0.01, 1.0, 2), (0.05, 200, 31, 100, 0.0, 0.95, 0.825, 0.02, 2.0, 1), (0.1, 100, 63, 50, 0.01, 0.86, 0.81, 0.03, 1.5, 3)]
    names = ["learning_rate", "max_iter", "max_leaf_nodes", "min_samples_leaf", "l2_regularization"]
    columns = [f"param_reg__{n}" for n in names] + ["mean_train_score", "mean_test_score", "std_test_score", "mean_fit_time", "rank_test_score"]
    return spark.createDataFrame(rows, columns)


def test_sweep_report(spark):
    made = sweep_tables(cv_sweep(spark), "hgb_lr_iter", "max_iter", "learning_rate", "run_a")
    summary = made["sweep_summary"].collect()
    assert [r["rank_test_score"] for r in summary] == [1, 2, 3] and summary[0]["run_id"] == "run_a"
    assert summary[0]["overfit_gap"] == pytest.approx(0.125) and summary[0]["max_depth"] is None
    report = made["sweep_report"].first()
    assert report["best_score"] == 0.825 and report["simplest_score"] == 0.8245 and report["overfit_warning"]
    assert report["recommended_region"] == "learning_rate=0.05; max_iter≈100–200; max_leaf_nodes=31; min_samples_leaf=100; l2_regularization=0"
    curve = {(r["learning_rate"], r["max_iter"]): r["mean_cv_r2"] for r in made["sweep_curve"].collect()}
    assert curve[(0.05, 200.0)] == 0.825 and len(curve) == 3
    assert [r["rank_test_score"] for r in made["overfit_gap_by_config"].collect()] == [1, 2, 3]
    assert sweep_tables(cv_sweep(spark), None, "max_iter") == {}


def test_sweep_spellings_and_missing_scores(spark):
    df = spark.createDataFrame([("0.5", 0.8), (None, 0.7), ("bad", 0.6)], "alpha string, mean_test_score double")
    assert [tuple(r) for r in selection.alpha_curve(df).collect()] == [(0.5, 0.8)]
    row = selection.sweep_summary(cv_sweep(spark).withColumnRenamed("param_reg__max_iter", "reg__max_iter").drop("mean_train_score"), "r").first()
    assert row["max_iter"] == 200 and row["overfit_gap"] is None


def test_diagnostics_with_scores(spark):
    rows = [("r", "Ridge", s, i, 1.0 + i, 1.5 + i) for s in ("test", "validation") for i in range(20)]
    stored = metrics.predictions_table(spark.createDataFrame(rows, "run_id string, model string, split string, row_id long, y_true double, y_pred double"))
    cv = cv_sweep(spark).withColumn("model", F.lit("HistGradientBoostingRegressor"))
    made = build_diagnostics(stored, metrics.model_comparison(stored), "r", cv_results=cv, sweep={"sweep_type": "hgb_single_param", "primary_param": "max_iter"})
    assert made["sweep_curve"].count() == 2 and made["ridge_alpha_curve"].isEmpty()


def test_a_retried_run_keeps_its_rows_once(spark, tmp_path):
    registry = runs.RunRegistry(spark, str(tmp_path))
    rows = spark.range(5)
    registry.put("metrics", "run_a", rows)
    registry.put("manifest", "run_b", rows.limit(1))
    assert registry.read("metrics").count() == 0
    registry.record("run_a", {"metrics": rows, "manifest": rows.limit(1)})
    assert registry.read("metrics").count() == 5


def test_fingerprint_tells_tables_apart(spark):
    def digest(rows, schema):
        return tables.table_fingerprint(spark.createDataFrame(rows, schema)).first()["digest"]

    text, number = "x string, y string", "x double"
    assert digest([("a", "b")] * 2, text) != digest([("q", "z")] * 2, text)
    assert digest([("a|b", "c")], text) != digest([("a", "b|c")], text) != digest([("a", None)], text)
    assert len({digest([(v,)], number) for v in (1e-10, 2e-10, 1e30, None)}) == 4
