"""Boosted trees of this library and models of Spark ML under one grid search."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import product

from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PolynomialExpansion, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from quintil.ml import boosting
from quintil.ml.design import Preparation, feature_types, prepare
from quintil.operators.classify import roc_auc
from quintil.operators.metrics import r2
from quintil.operators.splits import kfold, stratified_kfold
from quintil.session import settle

BOOSTED = ("hist_gradient_boosting", "boosted_classifier")
LEVEL_BOUNDS = {"polynomial_lasso": 4_000}  # products of all pairs of slots are dense; other models work on sparse rows or codes
CLASSIFIERS = ("logistic", "random_forest_classifier", "boosted_classifier", "linear_svm")


# Grid parameters that each estimator here can honour.
HONOURED = {
    "hist_gradient_boosting": "learning_rate max_iter max_depth max_leaf_nodes min_samples_leaf l2_regularization early_stopping validation_fraction n_iter_no_change tol",
    "random_forest": "n_estimators max_depth min_samples_leaf max_features bootstrap",
    "random_forest_classifier": "n_estimators max_depth min_samples_leaf bootstrap",
    "polynomial_lasso": "alpha",
    "logistic": "penalty C max_iter",
    "boosted_classifier": "learning_rate max_iter n_estimators max_depth min_samples_leaf subsample colsample l2_regularization early_stopping",
    "linear_svm": "C max_iter",
}


def refuse_ignored(model: str, params: Mapping[str, object]) -> None:
    """Fail on parameters that would not change the fit, unless they are off (None, False or 0)."""
    ignored = sorted(k for k, v in params.items() if v and k not in HONOURED.get(model, "").split())
    if ignored:
        raise ValueError(f"{model} cannot honour {', '.join(ignored)}; every value would give the same fit.")


def check_model(model: str, params: Mapping[str, object]) -> None:
    if model not in HONOURED:
        raise ValueError(f"Unsupported model {model!r}; there are {', '.join(sorted(HONOURED))}.")
    refuse_ignored(model, params)


def boost_settings(model: str, params: Mapping[str, object], seed: int = 42) -> boosting.Settings:
    """Settings of a boosted model; those that are not given keep the model's defaults."""
    check_model(model, params)
    p = {k: v for k, v in params.items() if v is not None}
    if model == "boosted_classifier":
        if "n_estimators" in p:
            p.setdefault("max_iter", p.pop("n_estimators"))
        if "colsample" in p:
            p["colsample"] = 1.0 if p["colsample"] == "all" else float(p["colsample"])
        return boosting.Settings(**{"max_iter": 20, "max_depth": 5, "min_samples_leaf": 1, **p, "max_leaf_nodes": None, "loss": "log", "seed": seed})
    if "max_leaf_nodes" in params and params["max_leaf_nodes"] is None:
        p["max_leaf_nodes"] = None
    return boosting.Settings(**{**p, "seed": seed})


def estimator(model: str, params: Mapping[str, object], rows: int, seed: int = 42) -> Pipeline:
    """Spark ML estimator for a model name and its grid parameters.

    Spark scales by the sample deviation; penalties are adjusted so that they act
    on features scaled by the population deviation. The intercept is not
    penalised, so features need no centring and stay sparse.
    """
    check_model(model, params)
    p = dict(params)
    shrink = (rows - 1) / rows if rows > 1 else 1.0
    common = {"featuresCol": "features", "labelCol": "label"}
    if model == "random_forest":
        stages = [
            RandomForestRegressor(
                **common,
                numTrees=int(p.get("n_estimators", 20)),
                maxDepth=int(p.get("max_depth") or 10),
                minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
                featureSubsetStrategy=str(p.get("max_features", "auto")),
                bootstrap=bool(p.get("bootstrap", True)),
                seed=seed,
            )
        ]
    elif model == "polynomial_lasso":
        stages = [
            StandardScaler(inputCol="features", outputCol="__scaled", withMean=True),
            PolynomialExpansion(degree=2, inputCol="__scaled", outputCol="__poly"),
            LinearRegression(
                featuresCol="__poly", labelCol="label", elasticNetParam=1.0, standardization=False,
                regParam=float(p.get("alpha", 0.01)), maxIter=500, tol=1e-8,
            ),
        ]
    elif model == "logistic":
        penalty = {None: (0.0, 0.0), "l2": (1.0, 0.0), "l1": (1.0, 1.0)}[p.get("penalty")]
        strength = 1.0 / (float(p.get("C", 1.0)) * rows) * (shrink**0.5 if penalty[1] else shrink)
        stages = [
            StandardScaler(inputCol="features", outputCol="__scaled", withMean=False),
            LogisticRegression(
                featuresCol="__scaled", labelCol="label", regParam=penalty[0] * strength, elasticNetParam=penalty[1],
                standardization=False, maxIter=int(p.get("max_iter", 100)),
            ),
        ]
    elif model == "random_forest_classifier":
        stages = [
            RandomForestClassifier(
                **common, numTrees=int(p.get("n_estimators", 20)), maxDepth=int(p.get("max_depth") or 10),
                minInstancesPerNode=int(p.get("min_samples_leaf", 1)), bootstrap=bool(p.get("bootstrap", True)), seed=seed,
            )
        ]
    else:
        stages = [
            StandardScaler(inputCol="features", outputCol="__scaled", withMean=False),
            LinearSVC(
                featuresCol="__scaled", labelCol="label", regParam=shrink / (float(p.get("C", 1.0)) * rows),
                standardization=False, maxIter=int(p.get("max_iter", 100)),
            ),
        ]
    return Pipeline(stages=stages)


@dataclass
class FittedModel:
    """Preparation and model fitted on the same training rows."""

    preparation: Preparation
    model: Model

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``y_pred``, and ``score`` for a classifier."""
        scored = self.model.transform(self.preparation.assemble(df, "features"))
        out = scored.withColumn("y_pred", F.col("prediction"))
        if "probability" in scored.columns:
            out = out.withColumn("score", vector_to_array("probability")[1])
        elif "rawPrediction" in scored.columns:
            out = out.withColumn("score", vector_to_array("rawPrediction")[1])
        return out.select(*df.columns, "y_pred", *(["score"] if "score" in out.columns else []))


@dataclass
class FittedBooster:
    """Boosted trees with the preparation fitted on the same rows."""

    booster: boosting.Booster

    @property
    def preparation(self) -> Preparation:
        return self.booster.encoder.preparation

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``y_pred``, and ``score`` for a classifier."""
        return self.booster.transform(df)


def fit_model(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    model: str,
    params: Mapping[str, object] | None = None,
    categorical: Sequence[str] = (),
    seed: int = 42,
) -> FittedModel | FittedBooster:
    used = train.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*features, target])]).persist(StorageLevel.MEMORY_AND_DISK)
    vectors = None
    try:
        if model in BOOSTED:
            return FittedBooster(boosting.fit(used, features, target, boost_settings(model, params or {}, seed), categorical))
        prepared = prepare(used, features, categorical, LEVEL_BOUNDS.get(model))
        vectors = _vectors(used, prepared, target).persist(StorageLevel.MEMORY_AND_DISK)
        rows = vectors.count()
        used.unpersist()  # the passes of the fit read the vectors alone
        return FittedModel(prepared, estimator(model, params or {}, rows, seed).fit(vectors))
    finally:
        used.unpersist()
        if vectors is not None:
            vectors.unpersist()


def _vectors(df: DataFrame, prepared: Preparation, target: str) -> DataFrame:
    return prepared.assemble(df, "features").select("features", F.col(target).cast("double").alias("label"))


def grid_points(grid: Mapping[str, Sequence[object]]) -> list[dict[str, object]]:
    """All combinations of a parameter grid, in grid order."""
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def _score(df: DataFrame, classifier: bool) -> float:
    if not classifier:
        return float(df.agg(r2("label", "prediction")).first()[0] or 0.0)
    if not {"probability", "rawPrediction"} & set(df.columns):
        return float(roc_auc(df, "label", "prediction").first()["auc"] or 0.0)
    raw = "probability" if "probability" in df.columns else "rawPrediction"
    scored = df.select("label", vector_to_array(raw)[1].alias("score"))
    return float(roc_auc(scored, "label", "score").first()["auc"] or 0.0)


@dataclass
class SearchResult:
    rows: list[dict[str, object]]
    best_params: dict[str, object]
    best_score: float
    best_std: float
    fit: FittedModel | FittedBooster
    seconds: float


@contextmanager
def _fold(
    model: str, inside: DataFrame, outside: DataFrame, features: Sequence[str], target: str, categorical: Sequence[str], seed: int
) -> Iterator[tuple[Callable, DataFrame, DataFrame]]:
    """How to fit one grid point on a fold, giving what predicts prepared rows, and the prepared rows of both sides.

    Rows are prepared once for all grid points, those of a boosted model as blocks of codes.
    """
    if model in BOOSTED:
        encoder = boosting.fit_encoder(inside, features, categorical)
        coded: dict[float, DataFrame] = {0.0: boosting.blocks_of(inside, encoder, target)}

        def boosted(params: Mapping[str, object]) -> Callable[[DataFrame], DataFrame]:
            settings = boost_settings(model, params, seed)
            share = boosting.held_share(inside, settings)
            if share not in coded:
                coded[share] = boosting.blocks_of(inside, encoder, target, share, seed)
            return boosting.fit_blocks(coded[share], encoder, settings).scored

        yield boosted, coded[0.0], boosting.blocks_of(outside, encoder, target)
        return
    prepared = prepare(inside, features, categorical, LEVEL_BOUNDS.get(model))
    fit_rows = _vectors(inside, prepared, target).persist(StorageLevel.MEMORY_AND_DISK)
    test_rows = _vectors(outside, prepared, target).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = fit_rows.count()
        yield (lambda params: estimator(model, params, n, seed).fit(fit_rows).transform), fit_rows, test_rows
    finally:
        fit_rows.unpersist()
        test_rows.unpersist()


def grid_search(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    model: str,
    grid: Mapping[str, Sequence[object]],
    folds: int = 3,
    categorical: Sequence[str] = (),
    key: str = "row_id",
    seed: int = 42,
    train_scores: bool = True,
    parallelism: int = 2,
) -> SearchResult:
    """All grid points on contiguous folds; the preparation is refitted per fold.

    A fold's vectors are prepared once and shared by its grid points, which are
    fitted concurrently as separate Spark jobs.
    """
    start = time.perf_counter()
    classifier = model in CLASSIFIERS
    used = train.select(*[F.col(f"`{c}`") for c in dict.fromkeys([key, *features, target])]).persist(StorageLevel.MEMORY_AND_DISK)
    folded = stratified_kfold(used, folds, target, key, "__fold") if classifier else kfold(used, folds, key, "__fold")
    points = grid_points(grid)
    scores: dict[int, list[tuple[float, float | None, float]]] = {i: [] for i in range(len(points))}
    for fold in range(folds):
        inside, outside = folded.filter(F.col("__fold") != fold), folded.filter(F.col("__fold") == fold)
        with _fold(model, inside, outside, features, target, categorical, seed) as (fit, fit_rows, test_rows):

            def one(params: Mapping[str, object]) -> tuple[float, float | None, float]:
                began = time.perf_counter()
                predicted = fit(params)
                spent = time.perf_counter() - began
                test = _score(predicted(test_rows), classifier)
                return test, _score(predicted(fit_rows), classifier) if train_scores else None, spent

            with ThreadPoolExecutor(parallelism) as pool:
                for i, result in enumerate(pool.map(one, points)):
                    scores[i].append(result)

    def mean(values: Sequence[float]) -> float:
        return sum(values) / len(values)

    rows = []
    for i, params in enumerate(points):
        tests = [s[0] for s in scores[i]]
        average = mean(tests)
        rows.append(
            {
                **{f"param_reg__{k}": v for k, v in params.items()},
                "mean_fit_time": mean([s[2] for s in scores[i]]),
                "mean_test_score": average,
                "std_test_score": math.sqrt(mean([(t - average) ** 2 for t in tests])),
                "mean_train_score": mean([s[1] for s in scores[i]]) if train_scores else None,
            }
        )
    for row in rows:
        row["rank_test_score"] = 1 + sum(other["mean_test_score"] > row["mean_test_score"] for other in rows)
    best = max(range(len(points)), key=lambda i: rows[i]["mean_test_score"])
    fit = fit_model(used, features, target, model, points[best], categorical, seed)
    used.unpersist()
    return SearchResult(rows, points[best], rows[best]["mean_test_score"], rows[best]["std_test_score"], fit, time.perf_counter() - start)


def search_frame(spark: SparkSession, result: SearchResult, model: str) -> DataFrame:
    """cv_results rows of one model as a frame; numbers are doubles."""
    names = list(result.rows[0])

    def value(name: str, v: object) -> object:
        if name == "rank_test_score" or v is None:
            return v
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    kinds = {}
    for name in names:
        sample = [value(name, r[name]) for r in result.rows if r[name] is not None]
        kinds[name] = "int" if name == "rank_test_score" else "string" if sample and isinstance(sample[0], str) else "double"
    schema = "model string, " + ", ".join(f"`{n}` {kinds[n]}" for n in names)
    data = [(model, *[value(n, r[n]) for n in names]) for r in result.rows]
    return spark.createDataFrame(data, schema)


def staged_scores(fitted: FittedBooster, train: DataFrame, test: DataFrame, target: str, every: int = 10) -> DataFrame:
    """R2 after every ``every``-th boosting step, with the best step marked."""
    booster = fitted.booster
    spark = train.sparkSession
    sides = {}
    for side, df in (("train", train), ("test", test)):
        total = df.agg(F.var_pop(F.col(target).cast("double"))).first()[0]
        sides[side] = [1.0 - mse / total for mse in booster.staged_errors(boosting.blocks_of(df, booster.encoder, target))]
    steps = [i for i in range(1, len(sides["train"]) + 1) if i % every == 0]
    rows = [(i, float(sides["train"][i - 1]), float(sides["test"][i - 1])) for i in steps]
    best = max(rows, key=lambda r: r[2])[0] if rows else None
    return spark.createDataFrame([(*r, r[0] == best) for r in rows], "iteration int, train_r2 double, test_r2 double, best boolean")


def depth_sweep(
    train: DataFrame, features: Sequence[str], target: str, depths: Sequence[int], folds: int = 5, max_iter: int = 20, **kwargs
) -> DataFrame:
    """CV score by tree depth, other parameters fixed."""
    grid = {"max_depth": list(depths), "max_iter": [max_iter], "learning_rate": [0.1], "min_samples_leaf": [15]}
    result = grid_search(train, features, target, "hist_gradient_boosting", grid, folds, train_scores=False, **kwargs)
    return search_frame(train.sparkSession, result, "HistGradientBoostingRegressor").select(
        F.col("param_reg__max_depth").cast("int").alias("max_depth"), "mean_test_score", "std_test_score"
    ).orderBy("max_depth")


def univariate_lines(df: DataFrame, columns: Sequence[str], target: str, split: str = "split") -> DataFrame:
    """Straight line per single column, fitted on train: slope, intercept and test R2.

    All columns share two passes: one for the lines, one for their test errors.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(split, F.col(target).alias("__y"), F.explode(entries).alias("e")).select(split, "__y", "e.*")
    long = long.filter(F.col("x").isNotNull() & ~F.isnan("x"))
    lines = long.filter(F.col(split) == "train").groupBy("column").agg(
        F.regr_slope("__y", "x").alias("slope"), F.regr_intercept("__y", "x").alias("intercept")
    )
    # One row per candidate column, which bounds this broadcast.
    scored = long.filter(F.col(split) == "test").join(F.broadcast(lines), "column")
    scored = scored.withColumn("__p", F.col("intercept") + F.col("slope") * F.col("x"))
    return scored.groupBy("column", "slope", "intercept").agg(
        F.lit("LinearRegression").alias("model"), r2("__y", "__p").alias("test_r2"),
        F.avg((F.col("__y") - F.col("__p")) * (F.col("__y") - F.col("__p"))).alias("test_mse"),
    )


def univariate_screen(
    df: DataFrame,
    columns: Sequence[str],
    target: str,
    models: Mapping[str, Mapping[str, object]],
    categorical: Sequence[str] = (),
    split: str = "split",
) -> DataFrame:
    """Every candidate column alone under every model: (column, model, test_r2, test_mse).

    Straight lines of all numeric columns come from one pass of moments, boosted trees of all columns from one pass of
    histograms. Other models have no such sums and are fitted column by column. Lines and polynomials need numbers, so
    they leave categorical columns out; a line leaves rows without a value out, the other models take the median.
    """
    rows = df.select(split, target, *[F.col(f"`{c}`") for c in columns]).persist(StorageLevel.MEMORY_AND_DISK)
    numbers = [c for c in columns if c in feature_types(df, columns, categorical)[0]]
    try:
        train, test = rows.filter(F.col(split) == "train"), rows.filter(F.col(split) == "test")
        found: list[DataFrame] = []
        blocks = None
        for model, params in models.items():
            label = F.lit(model).alias("model")
            if model == "linear_regression":
                if numbers:
                    found.append(univariate_lines(rows, numbers, target, split).select("column", label, "test_r2", "test_mse"))
            elif model == "hist_gradient_boosting":
                if blocks is None:
                    encoder = boosting.fit_encoder(train, columns, categorical)
                    blocks = encoder, boosting.blocks_of(train, encoder, target), boosting.blocks_of(test, encoder, target)
                screened = boosting.screen_columns(blocks[1], blocks[2], blocks[0], boost_settings(model, params))
                found.append(screened.select("column", label, "test_r2", "test_mse"))
            else:
                results = []
                for column in columns:
                    if model == "polynomial_lasso" and column not in numbers:
                        continue
                    fitted = fit_model(train, [column], target, model, params, categorical)
                    error = F.col(target) - F.col("y_pred")
                    score = fitted.transform(test).agg(r2(target, "y_pred").alias("r2"), F.avg(error * error).alias("mse")).first()
                    results.append((column, model, score["r2"], score["mse"]))
                found.append(df.sparkSession.createDataFrame(results, "column string, model string, test_r2 double, test_mse double"))
        out = found[0]
        for other in found[1:]:
            out = out.unionByName(other)
        return settle(out)
    finally:
        rows.unpersist()
