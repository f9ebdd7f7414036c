"""Document quality by Bradley-Terry ranking of preference pairs.

A document's utility is linear in statistics of its text. A document labelled 1 is preferred to one labelled 0, with
the logistic probability of the difference of their utilities; the weights are therefore a logistic regression without
intercept on feature differences. The utility at which the training sample splits best by quantile gets score
``THRESHOLD``; scores rise with utility from 0 to 1.

Labels are read from at most ``MAX_LABELS`` rows, the first by a hash of their id among those not held out, and
preferences from at most ``MAX_PAIRS`` pairs of them; both bounds are parameters. Everything else covers all rows.
Null texts count as empty and are scored like any other text. Labels without a document, null labels and labels other
than 0 and 1 are ignored; of repeated labels of one document the smallest counts. Without both labels every score is 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quintil.llm.text import remainder, words_of
from quintil.session import settle

MAX_LABELS = 20_000
MAX_PAIRS = 40_000
THRESHOLD = 0.3
HELD_OUT_MODULUS = 5
SYMBOLS = "#*$%&|<>"


def statistics(text: str | None) -> list[float]:
    """Features of a whole text: shares of its words or characters, and their square roots where they are rare."""
    text = text or ""
    words, size = words_of(text), max(len(text), 1)
    n = max(len(words), 1)
    lines = [line for line in text.split("\n") if line.strip()]
    shares = [
        sum(map(str.isupper, words)) / n,
        sum(map(text.count, SYMBOLS)) / size,
        text.count("|") / n,
        (text.count("!") + text.count("?")) / n,
        sum(map(text.count, "0123456789")) / size,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(words)) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        text.count(".") / n,
        text.count(",") / n,
        len(lines) / n,
    ]
    length = sum(map(len, words)) / n
    return [*shares, *(math.sqrt(s) for s in shares[:9]), math.log1p(len(words)), math.log1p(length), math.log1p(max(map(len, words), default=0))]


N_FEATURES = len(statistics(""))


def features(docs: DataFrame, key: str, text: str, kept: list[str]) -> DataFrame:
    """Columns of the key and ``kept``, and the array ``x``."""
    fields = [f for f in docs.schema if f.name in (key, *kept)]
    source = docs.select(*[docs[f.name] for f in fields], docs[text].alias("__text"))
    schema = T.StructType([*fields, T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t.as_py()) for t in batch.column("__text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], x], [*batch.schema.names[:-1], "x"])

    return source.mapInArrow(run, schema)


def training_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, max_labels: int) -> DataFrame:
    """(label, x, place): the sampled labelled documents, numbered within their label."""
    usable = labels.where((remainder(labels[key], HELD_OUT_MODULUS) != 0) & labels["quality"].isin(0, 1))
    single = usable.groupBy(F.col(key).alias("__key")).agg(F.min("quality").alias("label"))
    first = single.orderBy(F.xxhash64("__key"), "__key").limit(max_labels)
    chosen = docs.select(docs[key].alias("__key"), docs[text].alias("text")).join(F.broadcast(first), "__key")
    rows = features(chosen.dropDuplicates(["__key"]), "__key", "text", ["label"])
    return settle(rows.select("label", "x", F.expr("row_number() OVER (PARTITION BY label ORDER BY xxhash64(__key), __key) - 1").alias("place")))


class Ranking:
    """Weights of the standardised features and the utility that gets score THRESHOLD."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float) -> None:
        self.mean, self.weights, self.cut = mean, weights / scale, cut

    def scores(self, x: np.ndarray) -> np.ndarray:
        utility = (x - self.mean) @ self.weights - self.cut + math.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(utility, -700, 700)))


def fit(sample: DataFrame, max_pairs: int = MAX_PAIRS) -> Ranking | None:
    """Ranking learnt from pairs of one preferred and one other document; None without both labels."""
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    # At most MAX_LABELS rows, for the cut below and the scales.
    known = sample.select("label", "x").collect()
    x, label = np.array([r["x"] for r in known]), np.array([r["label"] for r in known])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    pairs = min(max_pairs, counts[0] * counts[1])
    # The k-th pair takes both sides in turn; whole turns of one side shift the other.
    turn = F.col("id") + F.floor(F.col("id") / F.lit(math.lcm(counts[0], counts[1])))
    ids = sample.sparkSession.range(pairs).select("id", (F.col("id") % counts[1]).alias("p"), (turn % counts[0]).alias("q"))
    better = sample.where("label = 1").select(F.col("place").alias("p"), F.col("x").alias("better"))
    worse = sample.where("label = 0").select(F.col("place").alias("q"), F.col("x").alias("worse"))
    sign = F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)
    scales = F.array(*[F.lit(float(s)) for s in scale])
    difference = F.transform(F.arrays_zip("better", "worse", scales.alias("s")), lambda t: (t["better"] - t["worse"]) / t["s"] * sign)
    rows = ids.join(better, "p").join(worse, "q").select(array_to_vector(difference).alias("features"), (sign > 0).cast("double").alias("label"))
    model = LogisticRegression(fitIntercept=False, standardization=False, regParam=1e-3, maxIter=100).fit(rows)
    weights = model.coefficients.toArray()
    utility = (x - mean) / scale @ weights
    return Ranking(mean, scale, weights, best_cut(utility, label))


def best_cut(utility: np.ndarray, label: np.ndarray) -> float:
    """The quantile of the utilities that separates the labels with the best balanced accuracy."""
    order = np.argsort(utility, kind="stable")
    values, good = utility[order], label[order] == 1
    below = np.cumsum(~good) / max((~good).sum(), 1) - np.cumsum(good) / max(good.sum(), 1)
    place = int(np.argmax(below))
    return float((values[place] + values[min(place + 1, len(values) - 1)]) / 2)


def score(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", kept: list[str] | None = None, max_labels: int = MAX_LABELS
) -> DataFrame:
    """(key, *kept, held_out, score, predicted) for every document; ``kept`` may hold the text itself."""
    ranking = fit(training_sample(docs, labels, key, text, max_labels))
    fields = [f for f in docs.schema if f.name in (key, *(kept or []))]
    source = docs.select(*[docs[f.name] for f in fields], docs[text].alias("__text"), (remainder(docs[key], HELD_OUT_MODULUS) == 0).alias("held_out"))
    added = [T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column("__text")]).reshape(-1, N_FEATURES)
            scores = np.full(len(x), 0.5) if ranking is None else ranking.scores(x)
            arrays = [*batch.columns[:-2], batch.column("held_out"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-2], "held_out", "score", "predicted"])

    return source.mapInArrow(run, T.StructType([*fields, *added]))
