"""Classification reports from labels and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quintil.operators.order import running_counts


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(
    df: DataFrame, label: str = "label", prediction: str = "prediction", keys: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall, F1 and support per class, with the overall accuracy."""
    keys = list(keys)
    cells = confusion_counts(df, label, prediction, keys)
    correct = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("label").alias("class"), correct.alias("hit"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("predicted")),
    )
    per_class = (
        cells.select(*keys, F.explode(sides).alias("s"))
        .groupBy(*keys, F.col("s.class").alias("class"))
        .agg(F.sum("s.hit").alias("hit"), F.sum("s.actual").alias("support"), F.sum("s.predicted").alias("predicted"))
    )
    precision = F.coalesce(F.try_divide(F.col("hit"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hit"), F.col("support")), F.lit(0.0))
    report = per_class.select(
        *keys,
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"),
        "support",
        "hit",
    )
    # One row per class: the window spans classes, not rows.
    overall = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    return report.withColumn("accuracy", F.sum("hit").over(overall) / F.sum("support").over(overall)).drop("hit")


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums, ties averaged.

    Equal scores are combined before they are ordered, so ties cost one row.
    """
    keys = list(keys)
    counts = (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*keys, F.col(score).cast("double").alias("score"))
        .agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col(label) == 1).alias("pos"))
    )
    ranked = running_counts(counts, "score", "c", keys)
    rank_sum = F.sum(F.col("pos") * (F.col("before") + (F.col("c") + 1) / 2))
    positives = F.sum("pos").cast("double")
    negatives = F.sum(F.col("c") - F.col("pos")).cast("double")
    auc = F.try_divide(rank_sum - positives * (positives + 1) / 2, positives * negatives).alias("auc")
    return ranked.groupBy(*keys).agg(auc) if keys else ranked.agg(auc)
