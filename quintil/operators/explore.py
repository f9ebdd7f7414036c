"""Exploratory tables: totals, distributions, correlations, determinism."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quintil.functions.quantiles import percentile_columns
from quintil.operators.metrics import join_null_safe
from quintil.operators.order import average_ranks
from quintil.session import BROADCAST_ROWS, settle, side_table

# Cut-offs used before plotting, as fixed values: (column, above, below).
FILTERS = {
    "income_boxplot": ("P47T", 0, 1_000_000),
    "log_boxplot": ("logP47T", 0, None),
    "income_histogram": ("P47T", 0, 50_000),
    "log_regression": ("logP47T", None, 6),
}


def range_filter(df: DataFrame, column: str, above: float | None = None, below: float | None = None) -> DataFrame:
    """Rows strictly inside an open interval."""
    if above is not None:
        df = df.filter(F.col(column) > above)
    if below is not None:
        df = df.filter(F.col(column) < below)
    return df


def plot_filter(df: DataFrame, name: str) -> DataFrame:
    column, above, below = FILTERS[name]
    return range_filter(df, column, above, below)


def _long(df: DataFrame, dimensions: Sequence[str], *carried: str) -> DataFrame:
    """(dimension, value as text, carried columns), one scan for all dimensions."""
    entries = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]
    )
    return df.select(F.explode(entries).alias("__e"), *carried).select("__e.*", *carried)


def sum_by_category(df: DataFrame, dimensions: Sequence[str], amount: str = "P47T") -> DataFrame:
    """Total of an amount per level of several dimensions; missing levels left out."""
    return (
        _long(df, dimensions, amount)
        .filter(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(F.sum(amount).alias("total"))
        .orderBy("dimension", F.desc("total"), "value")
    )


def describe_columns(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, minimum, quartiles and maximum per group and column, with the column's name in ``variable``.

    The columns are written once and share every pass.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("described"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns])
    held = settle(df.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*"))
    groups = [*keys, "described"]
    moments = held.groupBy(*groups).agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")
    )
    quartiles = percentile_columns(held, groups, {"x": {"p25": 0.25, "p50": 0.5, "p75": 0.75}})
    return join_null_safe(moments, quartiles, groups, "left").withColumnRenamed("described", "variable")


def describe_by(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The same for one column."""
    return describe_columns(df, keys, [column]).drop("variable")


def boxplot_stats(df: DataFrame, key: str, column: str) -> DataFrame:
    """Quartiles and whisker ends: the last points within 1.5 IQR of the box."""
    box = side_table(percentile_columns(df, [key], {column: {"q1": 0.25, "median": 0.5, "q3": 0.75}}))
    fenced = df.select(key, F.col(column).cast("double").alias("__x")).join(
        box.withColumnRenamed(key, "__k"), F.col(key).eqNullSafe(F.col("__k"))
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.when(F.col("__x").between(F.col("q1") - reach, F.col("q3") + reach), F.col("__x"))
    return fenced.groupBy(key, "q1", "median", "q3").agg(
        F.min(inside).alias("whisker_low"),
        F.max(inside).alias("whisker_high"),
        F.count_if(F.col("__x").isNotNull() & inside.isNull()).alias("fliers"),
    )


def iqr_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows outside the 1.5 IQR fences, per column. The columns are written once and share every pass."""
    df = settle(df.select(*[F.col(f"`{c}`") for c in columns]))
    spec = {c: {f"{c}__q1": 0.25, f"{c}__q3": 0.75} for c in columns}
    fences = percentile_columns(df, [], spec).first()
    counts = []
    for c in columns:
        q1, q3 = (F.lit(fences[f"{c}__{q}"]) for q in ("q1", "q3"))
        outside = (F.col(c) < q1 - 1.5 * (q3 - q1)) | (F.col(c) > q3 + 1.5 * (q3 - q1))
        counts.append(F.count_if(outside).alias(c))
    return df.agg(*counts).unpivot([], list(columns), "variable", "outliers")


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlations, every pair in the same pass."""
    pairs = list(combinations(columns, 2))
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).agg(
        *[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    )
    entries = F.array(
        *[
            F.struct(F.lit(a).alias("variable_1"), F.lit(b).alias("variable_2"), F.col(f"r{i}").alias("correlation"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(F.explode(entries).alias("e")).select("e.*")


def spearman_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Absolute rank correlation of every column pair, highest first; NaN counts as NULL.

    A pair is ranked on the rows that have both values. A column therefore has one set of ranks for all partners without
    NULLs, and one more for each partner with some. Equal values have equal ranks in every set: values are counted first,
    the ranks of all sets come from one range sort of the distinct values, and rows take them by value, column by column, in
    place of the value. Columns of few values are joined last, by broadcast.
    """
    values = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(f"x{i}") for i, c in enumerate(columns)]
    rows = settle(df.select(*values))
    numbers = range(len(columns))
    nulls = rows.agg(*[F.count_if(F.col(f"x{i}").isNull()).alias(f"x{i}") for i in numbers]).first()
    holed = [i for i in numbers if nulls[i]]
    present = [F.lit(1), *[F.col(f"x{o}").isNotNull().cast("int") for o in holed]]
    entries = [F.struct(F.lit(i).alias("grp"), F.col(f"x{i}").alias("value")) for i in numbers]
    long = rows.select(F.explode(F.array(*entries)).alias("e"), *[p.alias(f"w{k}") for k, p in enumerate(present)])
    weights = [f"w{k}" for k in range(len(present))]
    counts = long.select("e.*", *weights).where("value IS NOT NULL").groupBy("grp", "value").agg(*[F.sum(w).alias(w) for w in weights])
    ranks = settle(average_ranks(counts, "value", weights, ["grp"]))
    sizes = {r["grp"]: r["n"] for r in ranks.groupBy("grp").agg(F.count("*").alias("n")).collect()}

    def rank_of(column: int, partner: int) -> Column:
        return F.col(f"r{column}_{holed.index(partner) + 1 if partner in holed else 0}")

    for i in sorted(numbers, key=lambda i: -sizes.get(i, 0)):
        own = ranks.where(F.col("grp") == i).select(F.col("value").alias("v"), *[F.col(w).alias(f"r{i}_{k}") for k, w in enumerate(weights)])
        rows = rows.join(F.broadcast(own) if sizes.get(i, 0) <= BROADCAST_ROWS else own, F.col(f"x{i}") == F.col("v"), "left").drop(f"x{i}", "v")
    correlations = [
        F.struct(F.lit(columns[a]).alias("variable_1"), F.lit(columns[b]).alias("variable_2"), F.abs(F.corr(rank_of(a, b), rank_of(b, a))).alias("correlation"))
        for a, b in combinations(numbers, 2)
    ]
    return rows.agg(F.array(*correlations).alias("e")).select(F.explode("e").alias("e")).select("e.*").orderBy(F.desc("correlation"))


def pair_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Contingency counts of all column pairs in long form, one scan.

    Distinct value combinations are counted once, and the pairs are formed from
    those counts.
    """
    combos = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("<NA>")).alias(c) for c in columns])
    combos = combos.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    entries = F.array(
        *[
            F.struct(F.lit(a).alias("A"), F.lit(b).alias("B"), F.col(a).alias("a_value"), F.col(b).alias("b_value"))
            for a, b in combinations(columns, 2)
        ]
    )
    return (
        combos.select(F.explode(entries).alias("e"), "__n")
        .select("e.*", "__n")
        .groupBy("A", "B", "a_value", "b_value")
        .agg(F.sum("__n").alias("n"))
    )


def determinism_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Weighted mean of max P(B|A) and of max P(A|B) per pair; NULL is a level."""
    counts = pair_counts(df, columns)
    # The weights cancel the row totals: the score is sum of row maxima over n.
    given_a = counts.groupBy("A", "B", "a_value").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    forward = given_a.groupBy("A", "B").agg((F.sum("m") / F.sum("n")).alias("pmax_B_given_A"))
    given_b = counts.groupBy("A", "B", "b_value").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    backward = given_b.groupBy("A", "B").agg((F.sum("m") / F.sum("n")).alias("pmax_A_given_B"))
    return forward.join(backward, ["A", "B"])


def near_deterministic_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.98) -> DataFrame:
    """All pairs where one column nearly fixes the other, the strongest first."""
    found = determinism_scores(df, columns).filter(
        (F.col("pmax_B_given_A") >= threshold) | (F.col("pmax_A_given_B") >= threshold)
    )
    return found.orderBy(F.desc("pmax_B_given_A"), F.desc("pmax_A_given_B"), "A", "B")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequency of every level of every column."""
    return _long(df, columns).filter(F.col("value").isNotNull()).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, columns: Sequence[str], bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins per column and group, with counts and densities.

    The last bin includes the maximum; a constant column takes a unit-wide range
    around its value.
    """
    keys = list(keys)
    entries = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*").filter(F.col("x").isNotNull())
    span = side_table(
        long.groupBy(*keys, "variable").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("total"))
    )
    joined = join_null_safe(long, span, [*keys, "variable"])
    flat = F.col("hi") == F.col("lo")
    low = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")) / bins
    index = F.least(F.lit(bins - 1), F.floor((F.col("x") - low) / width)).cast("int")
    return (
        joined.select(*keys, "variable", "total", index.alias("bin"), low.alias("low"), width.alias("width"))
        .groupBy(*keys, "variable", "bin", "low", "width", "total")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            *keys,
            "variable",
            "bin",
            (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"),
            "n",
            (F.col("n") / (F.col("total") * F.col("width"))).alias("density"),
        )
    )


def density_2d(df: DataFrame, x: str = "y_true", y: str = "y_pred", grid: int = 45) -> DataFrame:
    """Counts on a grid of equal-width cells over two columns; rows with a NULL in either are left out."""
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    bounds = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()

    def cell(column: str, low: str, high: str) -> Column:
        if bounds[low] is None or bounds[low] == bounds[high]:
            return F.lit(0)
        width = (bounds[high] - bounds[low]) / grid
        return F.least(F.lit(grid - 1), F.floor((F.col(column) - bounds[low]) / width))

    return (
        df.select(cell(x, "x0", "x1").cast("int").alias("x_cell"), cell(y, "y0", "y1").cast("int").alias("y_cell"))
        .groupBy("x_cell", "y_cell")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def observed_vs_predicted(predictions: DataFrame, model: str, grid: int = 45) -> DataFrame:
    """Cell counts of one model's observed and predicted values."""
    return density_2d(predictions.filter(F.col("model") == model), grid=grid)


def observed_points(predictions: DataFrame, model: str) -> DataFrame:
    """The same as single points, for callers that want every one."""
    return predictions.filter(F.col("model") == model).select("y_true", "y_pred")


def geo_rank(df: DataFrame, year: str, area: str, amount: str = "P47T") -> DataFrame:
    """Rank of the mean income of an area within its year, as a fraction."""
    means = df.groupBy(year, area).agg(F.avg(amount).alias("mean_income"))
    share = F.cume_dist().over(W.partitionBy(year).orderBy("mean_income"))
    return means.select(year, area, F.round(share, 3).alias("rank"))


def geo_rank_join(df: DataFrame, ranks: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Attach a (year, area) rank table; areas without a rank stay NULL."""
    return df.join(side_table(ranks.withColumnRenamed("rank", name)), list(keys), "left")
