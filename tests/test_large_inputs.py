"""Work that must not be repeated as tables grow, and the exactness of what replaced it."""

import datetime
from decimal import Decimal
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quintil.ml import models, neighbors
from quintil.catalog import runs as stored
from quintil.operators import dataset, explore, household, order
from quintil.plans import experiment
from quintil.session import settle, settle_packed


def counted(spark, df):
    """The frame behind a column that counts how often its rows are made."""
    made = spark.sparkContext.accumulator(0)

    def one(x):
        made.add(1)
        return x

    return df.withColumn("made", F.udf(one, "long")("made")), made


def test_iqr_outliers_makes_its_rows_once(spark):
    df, made = counted(spark, spark.range(400).select(F.col("id").alias("made"), F.when(F.col("id") < 3, -9e9).otherwise(F.col("id")).alias("x")))
    got = {r["variable"]: r["outliers"] for r in explore.iqr_outliers(df, ["made", "x"]).collect()}
    assert got == {"made": 0, "x": 3} and made.value == 400


def test_attach_totals_makes_its_rows_once(spark):
    df, made = counted(spark, spark.range(60).select((F.col("id") % 7).alias("home"), F.col("id").alias("made")))
    rows = household.attach_totals(df, ["home"], {"n": F.count("made")}).collect()
    assert len(rows) == 60 and all(r["n"] == (9 if r["home"] < 4 else 8) for r in rows) and made.value == 60


def test_average_ranks_of_counted_values(spark):
    rng = np.random.default_rng(3)
    values, other = rng.integers(-20, 20, 500).astype(float), rng.random(500) < 0.4
    pdf = pd.DataFrame({"grp": 1, "v": values, "all": 1, "some": other.astype(int)}).groupby(["grp", "v"], as_index=False).sum()
    pdf = pd.concat([pdf, pdf.assign(grp=2)], ignore_index=True)
    got = order.average_ranks(spark.createDataFrame(pdf), "v", ["all", "some"], ["grp"]).collect()
    whole, part = pd.Series(values).rank(), pd.Series(values[other]).rank()
    assert len(got) == len(pdf)
    for r in got:
        assert r["all"] == whole[values == r["v"]].iloc[0]
        inside = part[values[other] == r["v"]]
        assert r["some"] == (inside.iloc[0] if len(inside) else None)


def test_closest_rows_keep_ties_and_exact_distances():
    rng = np.random.default_rng(4)
    points, refs = rng.normal(1e3, 1.0, (40, 8)), rng.normal(1e3, 1.0, (90, 8))
    refs[50:60] = refs[7]
    points[3] = refs[7]
    away = np.sqrt(((points[:, None, :] - refs[None, :, :]) ** 2).sum(axis=2))
    q, r, found = neighbors._closest_rows(points, refs, 3)
    assert np.array_equal(found, away[q, r])
    wanted = away <= np.sort(away, axis=1)[:, [2]]
    kept = np.zeros_like(wanted)
    kept[q, r] = True
    assert not (wanted & ~kept).any() and wanted[3].sum() == 11


def test_a_fit_holds_one_copy_of_its_rows(spark, monkeypatch):
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before, during = held(), []

    def fit(vectors):
        during.append(held())
        return vectors.count()

    monkeypatch.setattr(models, "estimator", lambda *args: SimpleNamespace(fit=fit))
    rows = spark.range(30).select((F.col("id") % 2).alias("y"), F.col("id").cast("double").alias("x"))
    assert models.fit_model(rows, ["x"], "y", "logistic").model == 30
    assert during == [before + 1] and held() == before


def test_studies_check_and_join_their_rows_once(spark, monkeypatch):
    from quintil.operators import splits

    data = spark.range(40).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("logP47T"), F.col("id").alias("ANO4"))
    df, made = counted(spark, data.withColumn("made", F.col("row_id")))
    seen = []

    def run(spec, dataset, assignments, name):
        frame, features = splits.prepare_frame(dataset, assignments)
        seen.append((frame.count(), features))
        table = spark.createDataFrame([(name,)], "run_id string")
        return SimpleNamespace(comparison=table, tables={"fixed_effect_coefficients": table})

    checks = []
    validate = splits.validate_splits
    monkeypatch.setattr(splits, "validate_splits", lambda *args: checks.append(validate(*args)))
    monkeypatch.setattr(experiment, "run_experiment", run)
    spec = experiment.Experiment("s", {"ridge": {"alpha": [1.0]}})
    experiment.fixed_effect_study(spec, df, splits.random_split(data), ("year_fe", "quarter_fe"))
    assert seen == [(40, ["ANO4", "made"])] * 2 and len(checks) == 1


def wide(spark, rows=40_000):
    """Two keys, 20 small numbers and a text for each row."""
    numbers = [((F.col("id") * 37 + i) % 9).cast("double").alias(f"x{i}") for i in range(20)]
    return spark.range(rows, numPartitions=3).select("id", (F.col("id") % 901).alias("home"), *numbers, F.concat(F.lit("row-"), "id").alias("name"))


def written_by(spark, work):
    """Bytes that ``work`` leaves in the checkpoint folder, and what it returns."""
    root = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = {p: p.stat().st_size for p in root.rglob("part-*")}
    made = work()
    return sum(p.stat().st_size for p in root.rglob("part-*") if p not in before), made


def test_wide_rows_are_written_packed(spark):
    df = wide(spark)
    plain, _ = written_by(spark, lambda: settle(df))
    ranked_bytes, ranked = written_by(spark, lambda: order.add_row_id(df, ["name"]))
    summed_bytes, summed = written_by(spark, lambda: household.attach_totals(df, ["home"], {"n": F.count(F.lit(1)), "top": F.max("x3")}))
    assert ranked_bytes < plain / 2 and summed_bytes < plain / 2
    want = {name: i for i, name in enumerate(sorted(f"row-{i}" for i in range(40_000)))}
    assert {r["name"]: r["row_id"] for r in ranked.select("name", "row_id").collect()} == want
    rows = summed.select("id", "home", "n", "top", "x3", "name").collect()
    assert len(rows) == 40_000
    tops = {}
    for r in rows:
        tops[r["home"]] = max(tops.get(r["home"], 0), r["x3"])
        assert r["x3"] == (r["id"] * 37 + 3) % 9 and r["name"] == f"row-{r['id']}"
    assert all(r["n"] == len(range(r["home"], 40_000, 901)) and r["top"] == tops[r["home"]] for r in rows)


def test_packed_rows_are_the_rows(spark):
    kinds = "a long, b int, c double, d string, e boolean, f date, g timestamp, h timestamp_ntz, i decimal(20,4), j binary, k float, l string"
    at = datetime.datetime(1969, 12, 31, 23, 59, 59, 123456)
    full = (1 << 60, -7, -0.0, "\u00e9\n", True, at.date(), at, at, Decimal("-1.2345"), bytearray(b"\x00z"), 0.5, "")
    rows = [full, (None,) * 12, (0, 0, float("inf"), None, False, None, None, at, None, bytearray(), None, "x")]
    df = spark.createDataFrame(rows, kinds).repartition(2).withColumn("part", F.spark_partition_id())
    df = settle(df.select("*", F.lit(1).alias("m")))
    whole, some, none = settle_packed(df, ["l", "c"], ["part"])
    assert whole.schema == df.schema and some.columns == ["c", "l"]
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, df.collect()))
    assert sorted(map(repr, some.collect())) == sorted(map(repr, df.select("c", "l").collect()))
    assert all(r["part"] == r["now"] for r in none.withColumn("now", F.spark_partition_id()).collect())
    lists = df.withColumn("z", F.array("a"))
    assert sorted(map(repr, settle_packed(lists)[0].collect())) == sorted(map(repr, lists.collect()))
    assert settle_packed(df.filter("a > 5 and a < 4"), ["a"])[1].count() == 0


def survey_tables(spark, root, orders=12):
    """The tables of the survey: three lines an order, one of which has no income."""
    from quintil.catalog.base import SCHEMAS

    def store(name, rows):
        spark.createDataFrame(rows, SCHEMAS[name]).write.parquet(f"{root}/{name}.parquet")

    def day(i):
        return datetime.datetime(1995 + i % 3, 1 + i, 2)

    store("region", [(0, "ASIA")])
    store("nation", [(3, "JAPAN", 0)])
    store("customer", [(1, "c", 3, 1.5, "m")])
    store("part", [(i, "p", "b", "t", 41 + i, 9.0) for i in range(10)])
    store("orders", [(i, 1, "O", 10.0, day(i), "1-URGENT") for i in range(orders)])
    store("lineitem", [
        (i, (i + k) % 9, i % 4, k + 1, 1.0 + 2 * i, 100.0 + i + k / 4, 0.05 * k, 0.02, "A" if k == 2 else "N", "F", day(i))
        for i in range(orders) for k in range(3)
    ])
    return str(root)


def seen_by(monkeypatch, module, name):
    """The columns of the frames that reach a function."""
    seen, inner = [], getattr(module, name)

    def spy(df, *args, **kwargs):
        seen.append(set(df.columns))
        return inner(df, *args, **kwargs)

    monkeypatch.setattr(module, name, spy)
    return seen


def test_sink_dataset_sorts_and_writes_the_modelling_columns_only(spark, tmp_path, monkeypatch):
    root = survey_tables(spark, tmp_path)
    ranked, summed = seen_by(monkeypatch, order, "order_rank"), seen_by(monkeypatch, household, "attach_totals")
    sunk = []
    sink = stored.tables.sink_dataset
    monkeypatch.setattr(stored.tables, "sink_dataset", lambda data, meta, path: sunk.append((data, meta)) or sink(data, meta, path))
    counts = stored.a11(spark, root).first()
    assert counts["n"] == counts["row_count_after_filters"] == sunk[0][0].count() > 0
    assert not ranked[0] & {"CODUSU", "INGRESO", "P47T", "P21", "T_VI", "logP21", "logT_VI"}
    assert {"P21", "T_VI"} <= summed[0] and not summed[0] & {"logP21", "logT_VI"}
    facts = sunk[0][1].first()
    assert facts["excluded_forbidden_predictors"] == sorted(["CODUSU", "INGRESO", "P47T", "P21", "T_VI", "logP21", "logT_VI"])
    assert {"logP21", "logT_VI", "Max_Nivel_Educativo", "Personas_0-3"} <= set(facts["engineered_columns"])
    data = sunk[0][0]
    assert data.columns[:2] == ["row_id", "logP47T"] and facts["feature_count"] == len(data.columns) - 2
    rows = data.orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(len(rows)))
    assert [r["person_key"] for r in rows] == sorted(r["person_key"] for r in rows)
    assert all(sum(r[c] for c in dataset.COMPOSITION) == 3 for r in rows)


def test_modeling_rows_are_sorted_without_what_is_left_out(spark, tmp_path, monkeypatch):
    from quintil.catalog import dataset as catalog

    root = survey_tables(spark, tmp_path)
    ranked = seen_by(monkeypatch, order, "order_rank")
    df = catalog.b5(spark, root)
    assert len(ranked) == 1 and ranked[0] == set(df.columns) - {"row_id"}
    assert not ranked[0] & {"CODUSU", "INGRESO", "P47T", "P21", "T_VI", "logP21", "logT_VI"}
    rows = df.orderBy("row_id").collect()
    places = [(r["ANO4"], r["person_key"]) for r in rows]
    assert [r["row_id"] for r in rows] == list(range(len(rows))) and places == sorted(places)
    # Every third line has no income.
    kept = [(i, k) for i in range(12) for k in range(2)]
    assert len(rows) == len(kept)
    by_key = {r["person_key"]: r for r in rows}
    for i, k in kept:
        r = by_key[f"{i}-{k + 1}-{(i + k) % 9}-{i % 4}-{100 + i + k / 4:.2f}-{1995 + i % 3}-{1 + i:02d}-02"]
        assert r["logP47T"] == round(np.log10(100 + i + k / 4), 6) and r["P03"] == 2 + 4 * i
        assert sum(r[c] for c in dataset.COMPOSITION) == 3
