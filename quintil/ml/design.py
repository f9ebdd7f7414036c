"""Feature preparation fitted on training rows: medians, modes, levels, scales."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quintil.functions.quantiles import exact_percentiles
from quintil.session import settle

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def feature_types(df: DataFrame, features: Sequence[str], categorical: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric and categorical features; declared categoricals win over their type."""
    types = dict(df.dtypes)
    numeric = [c for c in features if c not in categorical and (types[c] in NUMERIC_TYPES or types[c].startswith("decimal"))]
    return numeric, [c for c in features if c not in numeric]


def missing_as_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN counts as missing, like NULL."""
    types = dict(df.dtypes)
    floats = [c for c in columns if types[c] in ("float", "double")]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None)) for c in floats}) if floats else df


def level_table(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), max_levels: int | None = None) -> DataFrame:
    """Rows per (keys, column, value); with ``max_levels``, refused when there are more levels than that.

    Counting combines map-side, so a dominant level is one row per task.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    counts = settle(
        df.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*").groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    if max_levels is not None and counts.select("column", "value").distinct().limit(max_levels + 1).count() > max_levels:
        raise ValueError(f"Categorical columns have more than {max_levels} levels together.")
    return counts


def impute_statistics(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Median of numeric and most frequent level of categorical columns, as text and number."""
    parts = []
    if numeric:
        medians = exact_percentiles(df, numeric, [0.5])
        parts.append(medians.select(F.col("variable").alias("column"), F.col("q")[0].alias("median"), F.lit(None).cast("string").alias("mode")))
    if categorical:
        counts = level_table(df, categorical).filter(F.col("value").isNotNull())
        best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))
        parts.append(best.select("column", F.lit(None).cast("double").alias("median"), "mode"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def scale_statistics(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation per column, in one pass."""
    wide = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in numeric])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["mean"].alias("mean"), F.col(c)["std"].alias("std")) for c in numeric])
    return wide.select(F.explode(entries).alias("e")).select("e.*")


def scaled(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """(x - mean) / std with the population std; a constant column keeps scale 1."""
    stats = {r["column"]: (r["mean"], r["std"]) for r in scale_statistics(df, numeric).collect()}
    return df.withColumns({c: (F.col(c) - F.lit(stats[c][0])) / F.lit(stats[c][1] or 1.0) for c in numeric})


@dataclass
class Preparation:
    """Fitted preparation of one training set."""

    numeric: list[str]
    categorical: list[str]
    medians: Mapping[str, float] = field(default_factory=dict)
    modes: Mapping[str, str] = field(default_factory=dict)
    levels: Mapping[str, list[str]] = field(default_factory=dict)

    def number(self, column: str) -> Column:
        value = F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None))
        return F.coalesce(value, F.lit(float(self.medians.get(column) or 0.0)))

    def text(self, column: str) -> Column:
        value = F.col(f"`{column}`").cast("string")
        return F.coalesce(value, F.lit(self.modes[column])) if self.modes.get(column) is not None else value

    def names(self) -> list[str]:
        return [f"num__{c}" for c in self.numeric] + [f"cat__{c}_{v}" for c in self.categorical for v in self.levels[c]]

    def assemble(self, df: DataFrame, output: str = "features", keep_missing: bool = False) -> DataFrame:
        """Feature vector: imputed numerics, then one slot per known level.

        An unseen level sets no slot. With ``keep_missing`` every column gets one
        more slot for values outside the known levels.
        """
        out = df.withColumns({f"__n_{i}": self.number(c) for i, c in enumerate(self.numeric)})
        out = out.withColumns({f"__t_{i}": self.text(c) for i, c in enumerate(self.categorical)})
        inputs = [f"__n_{i}" for i in range(len(self.numeric))]
        made = list(inputs) + [f"__t_{i}" for i in range(len(self.categorical))]
        index, hot = [], []
        for i, c in enumerate(self.categorical):
            if self.levels[c]:
                indexer = StringIndexerModel.from_labels(
                    self.levels[c], inputCol=f"__t_{i}", outputCol=f"__i_{i}", handleInvalid="keep"
                )
                out = indexer.transform(out)
                index.append(f"__i_{i}")
                hot.append(f"__h_{i}")
            elif keep_missing:
                out = out.withColumn(f"__h_{i}", F.lit(1.0))
        if index:
            # The index columns' metadata names the slots, so this fit reads no data.
            out = OneHotEncoder(inputCols=index, outputCols=hot, dropLast=not keep_missing).fit(out).transform(out)
        inputs += [f"__h_{i}" for i, c in enumerate(self.categorical) if self.levels[c] or keep_missing]
        made += index + [f"__h_{i}" for i in range(len(self.categorical))]
        return VectorAssembler(inputCols=inputs, outputCol=output).transform(out).drop(*made)


def prepare(df: DataFrame, features: Sequence[str], categorical: Sequence[str] = (), max_levels: int | None = None) -> Preparation:
    """Medians, modes and sorted levels of a training set."""
    numeric, texts = feature_types(df, features, categorical)
    medians: dict[str, float] = {}
    if numeric:
        df = missing_as_null(df, numeric)
        nulls = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in numeric]).first()
        holes = [c for c in numeric if nulls[c]]
        if holes:
            medians = {r["variable"]: r["q"][0] for r in exact_percentiles(df, holes, [0.5]).collect()}
    modes: dict[str, str] = {}
    levels: dict[str, list[str]] = {c: [] for c in texts}
    if texts:
        counts: dict[str, list[tuple[int, str]]] = {c: [] for c in texts}
        for r in level_table(df, texts, max_levels=max_levels).filter(F.col("value").isNotNull()).collect():
            counts[r["column"]].append((-r["n"], r["value"]))
            levels[r["column"]].append(r["value"])
        modes = {c: min(v)[1] for c, v in counts.items() if v}
        levels = {c: sorted(v) for c, v in levels.items()}
    return Preparation(numeric, texts, medians, modes, levels)


def one_hot_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that set each slot: (feature, n). A check on the encoder's output.

    Sparse rows are added map-side, so one vector a task is shuffled, of any number of levels.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    fitted = prepare(df, columns, columns)
    total = fitted.assemble(df, "__v").agg(Summarizer.sum(F.col("__v")).alias("total"))
    slots = total.select(F.posexplode(vector_to_array("total")).alias("slot", "x"))
    names = F.array(*[F.lit(n) for n in fitted.names()])
    return slots.select(names[F.col("slot")].alias("feature"), F.col("x").cast("long").alias("n"))
