"""Linear models on designs of any width, by descent on sparse rows.

Beyond a few thousand levels a matrix of cross-products is too large for the driver. Here the driver holds the levels'
names and vectors of weights only: rows stay sparse, and each step of the descent sums gradients on the executors.
Columns of one fold's training set differ from another's only in the values that fill gaps, the scales and the level
that is dropped, so all sets share one persisted frame and one list of levels; a level that a set never saw has weight 0.

Same objectives as ``linear``: ridge adds alpha * |w|^2 to the squared error, lasso and elastic net penalise its half
mean. Where a penalty makes the weights unique they are the same; without one, fitted values are the same, but not what
is said of a level that the training set never saw. The training frame is released with ``close``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from quintil.functions.quantiles import exact_percentiles
from quintil.ml.design import Preparation, feature_types, level_table, missing_as_null
from quintil.operators.splits import kfold

TOLERANCE = 1e-13
MAX_STEPS = 5_000


@dataclass
class SparseDesign:
    """Filled, scaled and encoded columns of one training set, with the levels of all sets."""

    filled: Preparation
    scales: Mapping[str, tuple[float, float]]
    dropped: Mapping[str, str] = field(default_factory=dict)

    def assemble(self, df: DataFrame) -> DataFrame:
        """Adds the vector ``__x``; a dropped or unknown level sets no slot."""
        numbers = {f"__s_{i}": (self.filled.number(c) - F.lit(self.scales[c][0])) / F.lit(self.scales[c][1]) for i, c in enumerate(self.filled.numeric)}
        texts = {}
        for i, c in enumerate(self.filled.categorical):
            text = self.filled.text(c)
            texts[f"__c_{i}"] = F.nullif(text, F.lit(self.dropped[c])) if c in self.dropped else text
        levels = {f"__c_{i}": self.filled.levels[c] for i, c in enumerate(self.filled.categorical)}
        slots = Preparation(list(numbers), list(texts), levels=levels)
        return slots.assemble(df.withColumns(numbers | texts), "__x").drop(*numbers, *texts)

    def names(self) -> list[str | None]:
        """Name of each slot; None for dropped levels."""
        out: list[str | None] = [f"num__{c}" for c in self.filled.numeric]
        for c in self.filled.categorical:
            out += [None if self.dropped.get(c) == v else f"cat__{c}_{v}" for v in self.filled.levels[c]]
        return out


@dataclass
class WideFit:
    """A fitted model over sparse rows."""

    design: SparseDesign
    model: LinearRegressionModel

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``y_pred``."""
        return self.model.setFeaturesCol("__x").setPredictionCol("y_pred").transform(self.design.assemble(df)).drop("__x")

    def coefficients(self) -> list[tuple[str, float]]:
        weights = self.model.coefficients.toArray()
        return [(name, float(w)) for name, w in zip(self.design.names(), weights, strict=True) if name is not None]


class SparseTraining:
    """A training frame with contiguous folds, fitted on all of it or with one fold held out."""

    def __init__(self, df: DataFrame, features: Sequence[str], target: str, folds: int = 0, categorical: Sequence[str] = (), key: str = "row_id"):
        self.numeric, self.texts = feature_types(df, features, categorical)
        columns = [F.col(f"`{c}`") for c in dict.fromkeys(features)]
        used = missing_as_null(df, self.numeric).select(key, F.col(target).cast("double").alias("__y"), *columns)
        self.rows = kfold(used, folds, key, "__fold") if folds > 1 else used.withColumn("__fold", F.lit(0))
        self.rows = self.rows.persist(StorageLevel.MEMORY_AND_DISK)
        self.held_out = list(range(folds)) if folds > 1 else []
        self.sets = [-1, *self.held_out]  # -1: nothing is held out
        self.levels: dict[str, list[str]] = {c: [] for c in self.texts}
        self.modes: dict[int, dict[str, str]] = {s: {} for s in self.sets}
        self.first: dict[int, dict[str, str]] = {s: {} for s in self.sets}
        self._read_levels()
        self._read_numbers()

    def close(self) -> None:
        self.rows.unpersist()

    def _sets_of_row(self):
        """The sets that a row trains: all but the one that holds its fold out."""
        return F.array_except(F.array(*[F.lit(s) for s in self.sets]), F.array("__fold"))

    def _read_levels(self) -> None:
        if not self.texts:
            return
        counts = level_table(self.rows, self.texts, ["__fold"]).where("value IS NOT NULL")
        for r in counts.select("column", "value").distinct().toLocalIterator():
            self.levels[r["column"]].append(r["value"])
        for values in self.levels.values():
            values.sort()
        by_set = counts.select(F.explode(self._sets_of_row()).alias("set"), "column", "value", "n").groupBy("set", "column", "value").agg(F.sum("n").alias("n"))
        marks = by_set.groupBy("set", "column").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"), F.min("value").alias("first"))
        for r in marks.collect():
            self.modes[r["set"]][r["column"]], self.first[r["set"]][r["column"]] = r["mode"], r["first"]

    def _read_numbers(self) -> None:
        """Size, medians of columns with gaps, and scales of the filled columns of every set."""
        moments = [
            F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("var")).alias(f"m{i}")
            for i, c in enumerate(F.col(f"`{name}`").cast("double") for name in self.numeric)
        ]
        self.by_fold = self.rows.groupBy("__fold").agg(F.count("*").alias("rows"), F.avg("__y").alias("y"), F.var_pop("__y").alias("vy"), *moments).collect()
        holes = [c for i, c in enumerate(self.numeric) if any(r[f"m{i}"]["n"] < r["rows"] for r in self.by_fold)]
        self.medians: dict[int, dict[str, float]] = {s: {} for s in self.sets}
        if holes:
            copies = self.rows.select(F.explode(self._sets_of_row()).alias("set"), *[F.col(f"`{c}`") for c in holes])
            for r in exact_percentiles(copies, holes, [0.5], ["set"]).collect():
                self.medians[r["set"]][r["variable"]] = r["q"][0]

    def _scales(self, held_out: int) -> tuple[int, float, dict[str, tuple[float, float]]]:
        """Rows of a set, the target's sample deviation, and mean and deviation of the filled columns, put together from the folds'."""
        folds = [r for r in self.by_fold if r["__fold"] != held_out]
        rows = sum(r["rows"] for r in folds)
        scales = {}
        for i, c in enumerate(self.numeric):
            parts: list[Row] = [r[f"m{i}"] for r in folds if r[f"m{i}"]["n"]]
            known = sum(p["n"] for p in parts)
            fill = self.medians[held_out].get(c) or 0.0
            mean = (sum(p["n"] * p["mean"] for p in parts) + (rows - known) * fill) / max(rows, 1)
            square = sum(p["n"] * (p["var"] + (p["mean"] - mean) ** 2) for p in parts) + (rows - known) * (fill - mean) ** 2
            deviation = (square / max(rows, 1)) ** 0.5
            scales[c] = (mean, deviation if deviation > 1e-7 * max(1.0, abs(mean)) else 1.0)
        middle = sum(r["rows"] * r["y"] for r in folds) / max(rows, 1)
        around = sum(r["rows"] * (r["vy"] + (r["y"] - middle) ** 2) for r in folds)
        return rows, (around / max(rows - 1, 1)) ** 0.5, scales

    def fit(
        self, held_out: int, alpha: float = 0.0, l1_ratio: float | None = None, drop_first: Sequence[str] = ()
    ) -> tuple[WideFit, float | None, float | None]:
        """Fit on all folds but one; also the R2 on these rows and on the held-out fold."""
        rows, deviation, scales = self._scales(held_out)
        filled = Preparation(self.numeric, self.texts, self.medians[held_out], self.modes[held_out], self.levels)
        design = SparseDesign(filled, scales, {c: self.first[held_out][c] for c in drop_first if c in self.first[held_out]})
        train = design.assemble(self.rows.where(F.col("__fold") != held_out)).select("__x", "__y")
        # The solver divides the target by its deviation, which weakens its square penalty by that factor.
        sparse = alpha * (l1_ratio or 0.0)
        square = (alpha / max(rows, 1) if l1_ratio is None else alpha - sparse) * deviation
        strength = sparse + square
        solver = LinearRegression(
            featuresCol="__x", labelCol="__y", predictionCol="y_pred", solver="l-bfgs", standardization=False, tol=TOLERANCE, maxIter=MAX_STEPS,
            regParam=strength, elasticNetParam=sparse / strength if strength else 0.0,
        )
        model = solver.fit(train)
        if model.hasSummary and model.summary.totalIterations >= MAX_STEPS:
            raise ArithmeticError(f"Descent did not converge in {MAX_STEPS} steps: alpha={alpha}, l1_ratio={l1_ratio}.")
        fit = WideFit(design, model)
        error = F.pow(F.col("__y") - F.col("y_pred"), 2)
        sides = fit.transform(self.rows).groupBy((F.col("__fold") == held_out).alias("held")).agg(
            F.sum(error).alias("error"), (F.var_pop("__y") * F.count("__y")).alias("total")
        )
        scores = {r["held"]: 1.0 - r["error"] / r["total"] if r["total"] else None for r in sides.collect()}
        return fit, scores.get(False), scores.get(True)
