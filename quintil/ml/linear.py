"""Linear models for whole grids from one pass of cross-products.

Spark reduces the rows of every fold to one small matrix of cross-products.
Any number of penalties, their cross-validation scores and the refits follow
from these matrices, so a grid costs no further pass over the data. Matrices
are p x p; ``training_set`` takes wider designs to descent on sparse rows
(``wide``), which gives the same fits and needs no matrix.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import count

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from quintil.functions.quantiles import exact_percentiles
from quintil.ml.design import Preparation, feature_types, level_table, missing_as_null
from quintil.ml.wide import SparseTraining
from quintil.operators.splits import kfold

# Levels of all categorical columns up to which cross-products are one matrix on the driver.
MATRIX_LEVELS = 4_000

MODEL_NAMES = {
    "linear_regression": "LinearRegression",
    "ridge": "Ridge",
    "lasso": "Lasso",
    "elastic_net": "ElasticNet",
    "hist_gradient_boosting": "HistGradientBoostingRegressor",
}


@dataclass
class LinearFit:
    """A fitted model as plain numbers; predicting is one column expression."""

    preparation: Preparation
    intercept: float
    numeric: dict[str, tuple[float, float, float]]  # coefficient on the scaled column, mean, scale
    categorical: dict[str, dict[str, float]]

    def predict_column(self) -> Column:
        total = F.lit(float(self.intercept))
        for c, (w, mean, scale) in self.numeric.items():
            total = total + F.lit(w) * (self.preparation.number(c) - F.lit(mean)) / F.lit(scale)
        for c, weights in self.categorical.items():
            if weights:
                lookup = F.create_map(*[F.lit(v) for item in weights.items() for v in item])
                total = total + F.coalesce(lookup[self.preparation.text(c)], F.lit(0.0))
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``y_pred``."""
        return df.withColumn("y_pred", self.predict_column())

    def contribution(self, columns: Sequence[str]) -> Column:
        """Part of the prediction that a block of columns adds."""
        part = LinearFit(
            self.preparation,
            0.0,
            {c: v for c, v in self.numeric.items() if c in columns},
            {c: v for c, v in self.categorical.items() if c in columns},
        )
        return part.predict_column()

    def coefficients(self) -> list[tuple[str, float]]:
        rows = [(f"num__{c}", float(w)) for c, (w, _, _) in self.numeric.items()]
        return rows + [(f"cat__{c}_{v}", float(w)) for c, weights in self.categorical.items() for v, w in weights.items()]


@dataclass
class CrossProducts:
    """Per-fold cross-products and the statistics that fill missing values."""

    numeric: list[str]
    categorical: list[str]
    holes: list[str]
    levels: dict[str, list[str]]
    center: dict[str, float]
    spread: dict[str, float]
    target_center: float
    grams: dict[int, np.ndarray]
    medians: dict[int, dict[str, float]]  # per held-out fold; -1 holds the full training set
    counts: dict[int, dict[str, dict[str, int]]] = field(default_factory=dict)

    @property
    def held_out(self) -> list[int]:
        return list(self.grams)

    def fit(
        self, held_out: int, alpha: float = 0.0, l1_ratio: float | None = None, drop_first: Sequence[str] = ()
    ) -> tuple[LinearFit, float, float | None]:
        return fit_view(self, held_out, alpha, l1_ratio, drop_first=drop_first)

    def close(self) -> None:
        """Nothing is held but the matrices."""

    def _training(self, held_out: int) -> np.ndarray:
        return sum(g for f, g in self.grams.items() if f != held_out)

    def _level_counts(self, held_out: int, column: str) -> dict[str, int]:
        total: dict[str, int] = {}
        for fold, by_column in self.counts.items():
            if fold != held_out:
                for value, n in by_column.get(column, {}).items():
                    total[value] = total.get(value, 0) + n
        return total

    def view(self, held_out: int, drop_first: Sequence[str] = ()) -> tuple[np.ndarray, list[tuple[str, str | None]], dict[str, str]]:
        """Linear map from the stored columns to the imputed design of one
        training set, its column labels and the modes used."""
        stored: dict[tuple[str, str | None], int] = {}
        position = 1
        for c in self.numeric:
            stored[(c, None)] = position
            position += 1
        flags = {c: position + i for i, c in enumerate(self.holes)}
        position += len(self.holes)
        missing: dict[str, int] = {}
        for c in self.categorical:
            for v in self.levels[c]:
                stored[(c, v)] = position
                position += 1
            missing[c] = position
            position += 1
        size = position + 1
        labels: list[tuple[str, str | None]] = [(c, None) for c in self.numeric]
        modes: dict[str, str] = {}
        for c in self.categorical:
            seen = self._level_counts(held_out, c)
            if seen:
                modes[c] = min(seen, key=lambda v: (-seen[v], v))
            kept = [v for v in self.levels[c] if seen.get(v)]
            labels += [(c, v) for v in (kept[1:] if c in drop_first else kept)]
        view = np.zeros((size, len(labels) + 2))
        view[0, 0] = 1.0
        view[size - 1, -1] = 1.0
        for j, label in enumerate(labels, start=1):
            view[stored[label], j] = 1.0
            column, value = label
            if value is None:
                if column in flags:
                    raw = self.medians[held_out].get(column, self.center[column])
                    view[flags[column], j] = (raw - self.center[column]) / self.spread[column]
            elif modes.get(column) == value:
                view[missing[column], j] = 1.0
        return view, labels, modes


def training_set(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    folds: int = 0,
    categorical: Sequence[str] = (),
    key: str = "row_id",
    matrix_levels: int = MATRIX_LEVELS,
) -> CrossProducts | SparseTraining:
    """Cross-products, or sparse rows where the design is too wide for a matrix; both give the same fits where these are unique.

    Levels are estimated in one pass of sketches.
    """
    _, texts = feature_types(df, features, categorical)
    if texts:
        counted = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`").cast("string")).alias(f"n{i}") for i, c in enumerate(texts)]).first()
        if sum(counted) > matrix_levels:
            return SparseTraining(df, features, target, folds, categorical, key)
    return cross_products(df, features, target, folds, categorical, key)


def cross_products(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    folds: int = 0,
    categorical: Sequence[str] = (),
    key: str = "row_id",
) -> CrossProducts:
    """Reduce a training frame to one cross-product matrix per contiguous fold."""
    numeric, texts = feature_types(df, features, categorical)
    used = missing_as_null(df, numeric).select(key, F.col(target).cast("double").alias("__y"), *[F.col(f"`{c}`") for c in dict.fromkeys(features)])
    # Cuts, moments, levels and vectors all read the training columns.
    used = used.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _reduce(used, numeric, texts, folds, key)
    finally:
        used.unpersist()


def _reduce(used: DataFrame, numeric: list[str], texts: list[str], folds: int, key: str) -> CrossProducts:
    used = kfold(used, folds, key, "__fold") if folds > 1 else used.withColumn("__fold", F.lit(0))
    moments = used.agg(
        F.avg("__y").alias("y"),
        *[
            F.struct(
                F.avg(F.col(f"`{c}`").cast("double")).alias("m"),
                F.stddev_pop(F.col(f"`{c}`").cast("double")).alias("s"),
                F.count_if(F.col(f"`{c}`").isNull()).alias("k"),
            ).alias(f"m{i}")
            for i, c in enumerate(numeric)
        ],
    ).first()
    center = {c: moments[f"m{i}"]["m"] or 0.0 for i, c in enumerate(numeric)}
    spread = {c: moments[f"m{i}"]["s"] or 1.0 for i, c in enumerate(numeric)}
    holes = [c for i, c in enumerate(numeric) if moments[f"m{i}"]["k"]]
    medians: dict[int, dict[str, float]] = {f: {} for f in [-1, *range(max(folds, 1))]}
    if holes:
        # A row trains every set but the one that holds its fold out.
        sets = F.array_except(F.array(*[F.lit(f) for f in medians]), F.array("__fold")) if folds > 1 else F.array(F.lit(-1))
        copies = used.select(F.explode(sets).alias("__set"), *[F.col(f"`{c}`") for c in holes])
        for r in exact_percentiles(copies, holes, [0.5], ["__set"]).collect():
            medians[r["__set"]][r["variable"]] = r["q"][0]
    levels: dict[str, list[str]] = {c: [] for c in texts}
    counts: dict[int, dict[str, dict[str, int]]] = {}
    if texts:
        for r in level_table(used, texts, ["__fold"]).filter(F.col("value").isNotNull()).collect():
            counts.setdefault(r["__fold"], {}).setdefault(r["column"], {})[r["value"]] = r["n"]
        for by_column in counts.values():
            for c, by_value in by_column.items():
                levels[c] = sorted(set(levels[c]) | set(by_value))
    stored = Preparation(numeric, texts, {c: center[c] for c in numeric}, {}, levels)
    y0 = float(moments["y"] or 0.0)
    columns = used.withColumns(
        {
            **{c: (stored.number(c) - F.lit(center[c])) / F.lit(spread[c]) for c in numeric},
            **{f"__hole_{i}": F.col(f"`{c}`").isNull().cast("double") for i, c in enumerate(holes)},
            "__one": F.lit(1.0),
            "__y": F.col("__y") - F.lit(y0),
        }
    )
    plain = Preparation([*numeric, *[f"__hole_{i}" for i in range(len(holes))]], texts, {}, {}, levels)
    vectors = plain.assemble(columns, "__x", keep_missing=True)
    vectors = VectorAssembler(inputCols=["__one", "__x", "__y"], outputCol="__v").transform(vectors).select("__fold", "__v")
    rows = MLUtils.convertVectorColumnsFromML(vectors, "__v").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        grams = {}
        for fold in range(max(folds, 1)):
            gram = RowMatrix(rows.filter(F.col("__fold") == fold).select("__v")).computeGramianMatrix()
            grams[fold] = gram.toArray()
    finally:
        rows.unpersist()
    return CrossProducts(numeric, texts, holes, levels, center, spread, y0, grams, medians, counts)


def _solve(sxx: np.ndarray, sxy: np.ndarray, n: float, alpha: float, l1_ratio: float | None) -> np.ndarray:
    """Least squares (alpha 0), ridge (no ratio) or lasso/elastic net weights."""
    if alpha == 0:
        return np.linalg.pinv(sxx, rcond=1e-11, hermitian=True) @ sxy
    if l1_ratio is None:
        return np.linalg.solve(sxx + alpha * np.eye(len(sxx)), sxy)
    # Cyclic coordinate descent on RSS / 2n + alpha * (r * |w| + (1 - r) / 2 * w^2).
    a, b = sxx / n, sxy / n
    sparse, ridge = alpha * l1_ratio, alpha * (1 - l1_ratio)
    w, slope = np.zeros(len(b)), np.zeros(len(b))
    curvature = np.diag(a) + ridge
    # The objective is convex, so steps shrink to nothing; without that the weights are not reported.
    for sweep in count():
        largest = 0.0
        for j in range(len(b)):
            if curvature[j] <= 0:
                continue
            pull = b[j] - slope[j] + a[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - sparse, 0.0) / curvature[j]
            step = new - w[j]
            if step:
                slope += a[:, j] * step
                w[j] = new
                largest = max(largest, abs(step))
        if largest < 1e-12 * max(1.0, np.abs(w).max(initial=0.0)):
            return w
        if sweep >= 1_000_000 or not np.isfinite(w).all():
            raise ArithmeticError(f"Coordinate descent did not converge: alpha={alpha}, l1_ratio={l1_ratio}, last step {largest:g}.")


def fit_view(
    products: CrossProducts,
    held_out: int,
    alpha: float = 0.0,
    l1_ratio: float | None = None,
    scale_numeric: bool = True,
    drop_first: Sequence[str] = (),
    fit_intercept: bool = True,
) -> tuple[LinearFit, float, float | None]:
    """Fit on all folds but one; also the R2 on these rows and on the held-out fold."""
    view, labels, modes = products.view(held_out, drop_first)
    train = view.T @ products._training(held_out) @ view
    n = train[0, 0]
    means = train[0, 1:-1] / n
    size = len(labels)
    scale = np.ones(size)
    if scale_numeric:
        for j, (_, value) in enumerate(labels):
            if value is None:
                variance = train[j + 1, j + 1] / n - means[j] ** 2
                scale[j] = np.sqrt(variance) if variance > 1e-14 else 1.0
    shift = np.where([v is None for _, v in labels], means, 0.0) if scale_numeric else np.zeros(size)
    y0 = products.target_center
    # Columns are shifted and scaled by a change of basis of the cross-products.
    basis = np.zeros((size + 2, size + 2))
    basis[0, 0] = basis[-1, -1] = 1.0
    for j in range(size):
        basis[j + 1, j + 1] = 1.0 / scale[j]
        basis[0, j + 1] = -shift[j] / scale[j]
    if not fit_intercept:
        basis[0, -1] = y0
    moved = basis.T @ train @ basis
    xbar, ybar = moved[0, 1:-1] / n, moved[0, -1] / n
    sxx, sxy = moved[1:-1, 1:-1], moved[1:-1, -1]
    if fit_intercept:
        sxx, sxy = sxx - n * np.outer(xbar, xbar), sxy - n * xbar * ybar
    w = _solve(sxx, sxy, n, alpha, l1_ratio)
    offset = float(ybar - xbar @ w) if fit_intercept else 0.0

    def r2(gram: np.ndarray) -> float | None:
        moved_gram = basis.T @ view.T @ gram @ view @ basis
        direction = np.concatenate([[offset], w, [-1.0]])
        m = moved_gram[0, 0]
        total = moved_gram[-1, -1] - moved_gram[0, -1] ** 2 / m if m else 0.0
        return float(1.0 - direction @ moved_gram @ direction / total) if total > 0 else None

    numeric, categorical = {}, {c: {} for c in products.categorical}
    for (c, v), weight, s, mean in zip(labels, w, scale, shift, strict=True):
        if v is None:
            spread = products.spread[c]
            numeric[c] = (float(weight), float(products.center[c] + spread * mean), float(s * spread))
            if not scale_numeric:
                numeric[c] = (float(weight / spread), float(products.center[c]), 1.0)
        else:
            categorical[c][v] = float(weight)
    filled = Preparation(
        products.numeric, products.categorical, products.medians.get(held_out, {}), modes, {c: list(w) for c, w in categorical.items()}
    )
    intercept = offset + (y0 if fit_intercept else 0.0)
    return (
        LinearFit(filled, intercept, numeric, categorical),
        r2(products._training(held_out)),
        r2(products.grams[held_out]) if held_out in products.grams else None,
    )


CV_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("param_reg__alpha", T.DoubleType()),
        T.StructField("param_reg__l1_ratio", T.DoubleType()),
        T.StructField("mean_fit_time", T.DoubleType()),
        T.StructField("mean_test_score", T.DoubleType()),
        T.StructField("std_test_score", T.DoubleType()),
        T.StructField("mean_train_score", T.DoubleType()),
        T.StructField("rank_test_score", T.IntegerType()),
    ]
)
PATH_SCHEMA = (
    "model string, alpha double, mean_train_r2 double, mean_cv_r2 double, std_cv_r2 double, mean_fit_time double, "
    "coefficient_l1_norm double, coefficient_l2_norm double, nonzero_coefficients long"
)


@dataclass
class GridResult:
    """Scores of every grid point and the refit of the best one."""

    rows: list[tuple]
    best_params: dict[str, float]
    best_score: float
    best_std: float
    fit: object
    seconds: float


def grid_search(
    products: CrossProducts | SparseTraining,
    model: str,
    alphas: Sequence[float] = (0.0,),
    l1_ratios: Sequence[float] = (1.0,),
    drop_first: Sequence[str] = (),
) -> GridResult:
    """Cross-validated scores of a penalty grid; from cross-products they cost no pass over the data."""
    start = time.perf_counter()
    ratios = list(l1_ratios) if model == "elastic_net" else [None if model in ("ridge", "linear_regression") else 1.0]
    points = [(0.0 if model == "linear_regression" else float(a), r) for a in alphas for r in ratios]
    scored = []
    for alpha, ratio in points:
        began = time.perf_counter()
        fits = [products.fit(f, alpha, ratio, drop_first) for f in products.held_out]
        spent = (time.perf_counter() - began) / len(fits)
        tests, trains = np.array([f[2] for f in fits]), np.array([f[1] for f in fits])
        scored.append((alpha, ratio, spent, float(tests.mean()), float(tests.std()), float(trains.mean())))
    rows = [
        (MODEL_NAMES[model], None if model == "linear_regression" else a, r if model == "elastic_net" else None, t, m, s, tr,
         1 + sum(other[3] > m for other in scored))
        for a, r, t, m, s, tr in scored
    ]
    best = max(scored, key=lambda row: row[3])
    fit, _, _ = products.fit(-1, best[0], best[1], drop_first)
    params = {} if model == "linear_regression" else {"alpha": best[0]} | ({"l1_ratio": best[1]} if model == "elastic_net" else {})
    return GridResult(rows, params, best[3], best[4], fit, time.perf_counter() - start)


def cv_frame(spark: SparkSession, result: GridResult) -> DataFrame:
    return spark.createDataFrame(result.rows, CV_SCHEMA)


def coefficient_frame(spark: SparkSession, fit: LinearFit, model: str, run_id: str = "run") -> DataFrame:
    rows = [(run_id, model, name, weight) for name, weight in fit.coefficients()]
    return spark.createDataFrame(rows, "run_id string, model string, feature string, coefficient double")


def regularization_path(spark: SparkSession, products: CrossProducts | SparseTraining, model: str, alphas: Sequence[float]) -> DataFrame:
    """Scores, norms and sparsity by alpha; every alpha is refitted on all rows."""
    search = grid_search(products, model, list(dict.fromkeys(float(a) for a in alphas)))
    rows = []
    for name, alpha, _, seconds, mean, std, train, _ in search.rows:
        fit, _, _ = products.fit(-1, alpha, None if model == "ridge" else 1.0)
        w = np.array([c for _, c in fit.coefficients()])
        rows.append((name, alpha, train, mean, std, seconds, float(np.abs(w).sum()), float(np.sqrt((w**2).sum())), int((np.abs(w) > 1e-10).sum())))
    return spark.createDataFrame(sorted(rows, key=lambda r: r[1]), PATH_SCHEMA)
