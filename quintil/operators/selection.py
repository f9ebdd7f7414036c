"""Choosing models and grid points from score tables.

These tables have one row per configuration, model or coefficient.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quintil.functions.scalar import sign_label, to_number

SWEEP_PARAMS = (
    "learning_rate", "max_iter", "max_leaf_nodes", "max_depth", "min_samples_leaf", "l2_regularization", "early_stopping",
)
REGION_PARAMS = ("learning_rate", "max_iter", "max_leaf_nodes", "min_samples_leaf", "l2_regularization")
TOLERANCE = 0.002
OVERFIT_LINE = 0.10
NONZERO = 1e-10


def param_column(columns: Sequence[str], name: str) -> Column:
    """A grid parameter under any of its three spellings, NULL when absent."""
    present = [F.col(c) for c in (f"param_reg__{name}", f"reg__{name}", name) if c in columns]
    return F.coalesce(*present) if present else F.lit(None).cast("double")


def _score(columns: Sequence[str], name: str) -> Column:
    return F.col(name).cast("double") if name in columns else F.lit(None).cast("double")


def sweep_summary(cv_results: DataFrame, run_id: str | None = None, model: str = "HistGradientBoostingRegressor") -> DataFrame:
    """Parameters, scores, overfit gap, time and rank of every configuration."""
    columns = cv_results.columns
    train, test = _score(columns, "mean_train_score"), _score(columns, "mean_test_score")
    return cv_results.select(
        (F.col("run_id") if "run_id" in columns else F.lit(run_id).cast("string")).alias("run_id"),
        (F.col("model") if "model" in columns else F.lit(model)).alias("model"),
        *[param_column(columns, p).alias(p) for p in SWEEP_PARAMS],
        train.alias("mean_train_score"),
        test.alias("mean_test_score"),
        _score(columns, "std_test_score").alias("std_test_score"),
        (train - test).alias("overfit_gap"),
        _score(columns, "mean_fit_time").alias("mean_fit_time"),
        (F.col("rank_test_score").cast("int") if "rank_test_score" in columns else F.lit(None).cast("int")).alias("rank_test_score"),
    ).orderBy(F.col("rank_test_score").asc_nulls_last())


def sweep_curve(summary: DataFrame, primary: str, group: str | None = None) -> DataFrame:
    """Mean scores by the swept parameter, and by a second one if given."""
    keys = [group, primary] if group else [primary]
    numeric = summary.withColumns({c: to_number(c) for c in keys})
    return (
        numeric.dropna(subset=[*keys, "mean_test_score"])
        .groupBy(*keys)
        .agg(
            F.avg("mean_test_score").alias("mean_cv_r2"),
            F.avg("std_test_score").alias("std_cv_r2"),
            F.stddev_samp("mean_test_score").alias("std_of_scores"),
            F.avg("mean_train_score").alias("mean_train_r2"),
            F.avg("overfit_gap").alias("mean_overfit_gap"),
            F.avg("mean_fit_time").alias("mean_fit_time"),
        )
        .orderBy(*keys)
    )


def cv_rank(cv_results: DataFrame, score: str = "mean_test_score", keys: Sequence[str] = ("model",)) -> DataFrame:
    """Minimum rank by descending score, as grid search numbers it."""
    return cv_results.withColumn("rank_test_score", F.rank().over(W.partitionBy(*keys).orderBy(F.desc(score))))


def _then(df: DataFrame, *first: Column) -> list[Column]:
    """A total order: the given keys, then all columns by name, so equal scores fall the same way every time."""
    return [*first, *[F.col(f"`{c}`").asc_nulls_last() for c in sorted(df.columns)]]


def top_configs(summary: DataFrame, n: int = 20) -> DataFrame:
    return summary.orderBy(*_then(summary, F.col("rank_test_score").asc_nulls_last())).limit(n)


def by_overfit_gap(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.col("overfit_gap").desc_nulls_last())


def top_config_curve(summary: DataFrame, n: int = 20, order: Sequence[str] = ("rank_test_score",)) -> DataFrame:
    """Train and CV score of the best configurations, numbered from 1."""
    scored = summary.dropna(subset=["mean_train_score", "mean_test_score"])
    total = _then(scored, *[F.col(c) if isinstance(c, str) else c for c in order])
    top = scored.orderBy(*total).limit(n)
    position = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*total))
    return top.select(position.alias("config_rank"), "mean_train_score", "mean_test_score")


def best_model(comparison: DataFrame, metric: str = "validation_r2", tie: str = "model") -> DataFrame:
    return comparison.filter(F.col(metric).isNotNull()).orderBy(F.desc(metric), tie).limit(1)


def _near_best(summary: DataFrame, tolerance: float) -> DataFrame:
    best = summary.agg(F.max(to_number("mean_test_score"))).scalar()
    return summary.filter(to_number("mean_test_score") >= best - tolerance)


def simplest_within(summary: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Simplest configuration close to the best score: few iterations, few
    leaves, large leaves, little penalty, then the higher score."""
    near = _near_best(summary, tolerance)
    order = [
        to_number("max_iter").asc_nulls_last(),
        to_number("max_leaf_nodes").asc_nulls_last(),
        to_number("min_samples_leaf").desc_nulls_last(),
        to_number("l2_regularization").asc_nulls_last(),
        F.desc("mean_test_score"),
    ]
    return near.orderBy(*_then(near, *order)).limit(1)


def _plain(value: Column) -> Column:
    """Number text with six significant digits and without trailing zeros."""
    text = F.format_string("%.6g", value)
    short = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+($|e)", "$1$2"), r"\.($|e)", "$1")
    return F.when(value == 0, "0").otherwise(short)


def recommended_region(summary: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Range of every parameter among near-best configurations, as one text."""
    present = [p for p in REGION_PARAMS if p in summary.columns]
    ranges = _near_best(summary, tolerance).agg(
        *[F.min(to_number(p)).alias(f"{p}__lo") for p in present], *[F.max(to_number(p)).alias(f"{p}__hi") for p in present]
    )
    pieces = []
    for p in present:
        lo, hi = F.col(f"{p}__lo"), F.col(f"{p}__hi")
        one = F.concat(F.lit(f"{p}="), _plain(lo))
        span = F.concat(F.lit(f"{p}≈"), _plain(lo), F.lit("–"), _plain(hi))
        pieces.append(F.when(lo.isNotNull(), F.when(lo == hi, one).otherwise(span)))
    text = F.array_join(F.array_compact(F.array(*pieces)), "; ")
    return ranges.select(
        F.when(text == "", "No numeric parameter region could be inferred.").otherwise(text).alias("recommended_region")
    )


def _config_text() -> Column:
    parts = [F.when(F.col(p).isNotNull(), F.concat(F.lit(f"{p}="), F.col(p).cast("string"))) for p in SWEEP_PARAMS]
    return F.array_join(F.array_compact(F.array(*parts)), ", ")


def sweep_report(summary: DataFrame, tolerance: float = TOLERANCE, line: float = OVERFIT_LINE) -> DataFrame:
    """One row: best and simplest configuration, gap warning and region."""
    scored = summary.filter(to_number("mean_test_score").isNotNull())
    best = scored.orderBy(*_then(scored, F.desc("mean_test_score"), F.col("rank_test_score").asc_nulls_last())).limit(1)
    simple = simplest_within(scored, tolerance).select(
        F.struct(F.col("mean_test_score").alias("score"), _config_text().alias("text")).alias("s")
    ).scalar()
    return best.select(
        "run_id",
        F.col("mean_test_score").alias("best_score"),
        F.col("std_test_score").alias("best_std"),
        _config_text().alias("best_config"),
        simple["score"].alias("simplest_score"),
        simple["text"].alias("simplest_config"),
        F.col("overfit_gap").alias("best_overfit_gap"),
        F.coalesce(F.col("overfit_gap") > line, F.lit(False)).alias("overfit_warning"),
        recommended_region(scored, tolerance).scalar().alias("recommended_region"),
    )


def top_k(df: DataFrame, by: str, k: int, keys: Sequence[str] = ("model",), tie: str = "feature_or_group") -> DataFrame:
    """First ``k`` rows per group by descending value."""
    position = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(by), tie))
    return df.withColumn("position", position).filter(F.col("position") <= k)


def top_k_per_block(
    coefficients: DataFrame,
    prefixes: Mapping[str, str],
    sort_by: str,
    k: int | None = None,
    order: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Largest coefficients per feature block, with labels.

    ``prefixes`` maps a block title to its feature prefix; ``order`` fixes the
    label order of some blocks.
    """
    blocks = F.array(*[F.struct(F.lit(t).alias("block"), F.lit(p).alias("prefix")) for t, p in prefixes.items()])
    matched = coefficients.withColumn("__b", F.explode(F.filter(blocks, lambda b: F.startswith(F.col("feature"), b["prefix"]))))
    labelled = matched.select(
        F.col("__b.block").alias("block"),
        *coefficients.columns,
        F.replace(F.col("feature"), F.col("__b.prefix"), F.lit("")).alias("label"),
    )
    size = F.row_number().over(W.partitionBy("block").orderBy(F.desc(F.abs(sort_by)), "feature"))
    ranked = labelled.withColumn("position", size)
    if k is not None:
        ranked = ranked.filter(F.col("position") <= k)
    if order:
        fixed = F.lit(None).cast("int")
        for title, labels in order.items():
            place = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col("label")).cast("int")
            fixed = F.when(F.col("block") == title, place).otherwise(fixed)
        ranked = ranked.withColumn("position", F.coalesce(fixed, F.col("position")))
    return ranked.orderBy("block", "position")


def comparison_order(comparison: DataFrame) -> DataFrame:
    return comparison.orderBy(to_number("validation_r2").desc_nulls_last())


def best_notes(comparison: DataFrame) -> DataFrame:
    """Best runs by three metrics and the feature counts seen: (note, text)."""
    who = F.struct("run_id", "model")

    def best(metric: str, label: str, highest: bool) -> Column:
        value = to_number(metric)
        # Of equal values the first run and model by name owns the note.
        place = F.struct((-value if highest else value).alias("v"), "run_id", "model")
        owner = F.min_by(who, F.when(value.isNotNull(), place))
        edge = F.max(value) if highest else F.min(value)
        text = F.concat(
            F.lit(f"{label}: "), _plain(edge), F.lit(" ("), owner["run_id"], F.lit(" / "), owner["model"], F.lit(")")
        )
        return F.coalesce(text, F.lit(f"{label}: unavailable"))

    counts = F.sort_array(F.collect_set(F.col("feature_count").cast("string")))
    row = comparison.agg(
        best("validation_r2", "Best validation R2", True).alias("best_validation_r2"),
        best("cv_r2_mean", "Best CV R2", True).alias("best_cv_r2"),
        best("validation_mae", "Lowest validation MAE", False).alias("lowest_validation_mae"),
        F.when(
            F.size(counts) > 1, F.concat(F.lit("Warning: feature_count differs: "), F.array_join(counts, ", "))
        ).alias("feature_count_warning"),
    )
    return row.unpivot([], row.columns, "note", "text").filter(F.col("text").isNotNull())


def best_per_column(results: DataFrame, column: str = "column", metric: str = "test_r2") -> DataFrame:
    """Best model per single feature; ``overall`` marks the best of them all."""
    rows = F.struct(*[c for c in results.columns if c != column])
    best = results.groupBy(column).agg(F.max_by(rows, F.struct(metric, "model")).alias("b")).select(column, "b.*")
    # One row per column; a window, so that the scores are not computed twice.
    return best.withColumn("overall", F.col(metric) == F.max(metric).over(W.partitionBy(F.lit(1))))


def alpha_curve(cv_results: DataFrame) -> DataFrame:
    alpha = to_number(param_column(cv_results.columns, "alpha").cast("string"))
    curve = cv_results.select(alpha.alias("alpha"), to_number("mean_test_score").alias("mean_test_score"))
    return curve.dropna().orderBy("alpha")


def coefficient_table(coefficients: DataFrame, keys: Sequence[str] = ("run_id", "model")) -> DataFrame:
    """Adds the absolute value and its descending rank to (feature, coefficient)."""
    sized = coefficients.withColumn("abs_coefficient", F.abs("coefficient"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("abs_coefficient"), "feature"))
    return sized.withColumn("abs_rank", rank)


def coefficient_norms(coefficients: DataFrame, keys: Sequence[str] = ("run_id", "model")) -> DataFrame:
    return coefficients.groupBy(*keys).agg(
        F.sum(F.abs("coefficient")).alias("coefficient_l1_norm"),
        F.sqrt(F.sum(F.col("coefficient") * F.col("coefficient"))).alias("coefficient_l2_norm"),
        F.count_if(F.abs("coefficient") > NONZERO).alias("nonzero_coefficients"),
    )


def effect_coefficients(
    coefficients: DataFrame, effects: Sequence[Mapping[str, object]], models: Sequence[str] = ("LinearRegression", "Ridge", "Lasso")
) -> DataFrame:
    """Coefficients of generated effect columns, ranked within model and effect."""
    prefixes = {str(e["fe_name"]): f"cat__{e['generated_column']}_" for e in effects}
    blocks = F.array(*[F.struct(F.lit(n).alias("fe_name"), F.lit(p).alias("prefix")) for n, p in prefixes.items()])
    matched = coefficients.filter(F.col("model").isin(*models)).withColumn(
        "__b", F.explode(F.filter(blocks, lambda b: F.startswith(F.col("feature"), b["prefix"])))
    )
    rank = F.row_number().over(W.partitionBy("run_id", "model", "fe_name").orderBy(F.desc("abs_coefficient"), "feature"))
    return matched.select(
        "run_id",
        "model",
        F.col("__b.fe_name").alias("fe_name"),
        F.expr("substring(feature, length(__b.prefix) + 1)").alias("level"),
        "feature",
        "coefficient",
        F.abs("coefficient").alias("abs_coefficient"),
        sign_label("coefficient").alias("sign"),
    ).withColumn("rank", rank)


def join_coefficients(tables: Mapping[str, DataFrame], digits: int = 4) -> DataFrame:
    """Inner join of (feature, coefficient) tables, one column per model."""
    joined: DataFrame | None = None
    for name, table in tables.items():
        one = table.select("feature", F.round("coefficient", digits).alias(name))
        joined = one if joined is None else joined.join(one, "feature")
    if joined is None:
        raise ValueError("No coefficient tables were given.")
    return joined
