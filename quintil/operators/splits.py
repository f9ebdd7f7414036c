"""Splits, samples and folds with exact sizes and a reproducible order."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quintil.contract import SPLITS, Contract, reject_forbidden, require_columns
from quintil.functions.quantiles import order_statistics
from quintil.operators.order import HASH_DIGITS, hash_cuts, hash_order
from quintil.session import settle

SPLIT_SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("split", T.StringType())])


def _share(fraction: float) -> Callable[[Column], Column]:
    """Half-even rounding of a share of the row count."""
    return lambda n: F.bround(n * F.lit(float(fraction))).cast("long")


def _before(place: Column, cut: str | None) -> Column:
    """Whether a hash lies before a cut; no cut means that every row does."""
    return F.lit(True) if cut is None else place < F.lit(cut)


def with_split(
    df: DataFrame,
    key: str = "row_id",
    sizes: Sequence[float] = (0.7, 0.2, 0.1),
    seed: int = 42,
    digits: int = HASH_DIGITS,
    name: str = "split",
) -> DataFrame:
    """The rows with their exact train/test/validation split, map-only once two cuts are known.

    The shuffled order is cut at ``round(0.7 n)`` and ``round(0.2 n)`` rows
    further; a row's split follows from comparing its hash with the two cuts.
    Equal keys would fall on one side together, so repeated keys are refused.
    The keys are written once for the checks and counts that the cuts need.
    """
    if abs(sum(sizes) - 1.0) > 1e-8:
        raise ValueError(f"The shares of the splits must sum to 1, and give {sum(sizes)}.")
    keys = settle(df.select(key))
    require_unique(keys, key, "The table to split")
    train, test = _share(sizes[0]), _share(sizes[1])
    cut = hash_cuts(
        keys, key, seed, {"train_end": train, "test_end": lambda n: F.least(train(n) + test(n), n)}, digits=digits
    ).first()
    place = hash_order(seed, key)
    split = F.when(_before(place, cut["train_end"]), "train").when(_before(place, cut["test_end"]), "test").otherwise("validation")
    return df.withColumn(name, split)


def random_split(df: DataFrame, key: str = "row_id", sizes: Sequence[float] = (0.7, 0.2, 0.1), seed: int = 42, digits: int = HASH_DIGITS) -> DataFrame:
    """The split of every key, as a table of assignments."""
    return with_split(df.select(key), key, sizes, seed, digits)


def nested_split(df: DataFrame, key: str = "row_id", seed: int = 42, digits: int = HASH_DIGITS) -> DataFrame:
    """Validation first (10 %, rounded up), then 2/9 of the rest as test."""

    def held(n: Column) -> Column:
        return F.ceil(n * F.lit(0.1))

    def tested(n: Column) -> Column:
        return held(n) + F.ceil((n - held(n)) * F.lit(2.0) / F.lit(9.0))

    cut = hash_cuts(df, key, seed, {"held": held, "tested": tested}, digits=digits).first()
    place = hash_order(seed, key)
    return df.select(
        F.col(key),
        F.when(_before(place, cut["held"]), "validation")
        .when(_before(place, cut["tested"]), "test")
        .otherwise("train")
        .alias("split"),
    )


def split_counts(assignments: DataFrame) -> DataFrame:
    """Rows per split, zero for a split without rows."""
    totals = assignments.agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    return totals.unpivot([], list(SPLITS), "split", "n")


def split_proportions(assignments: DataFrame) -> DataFrame:
    counts = assignments.agg(
        F.count("split").alias("__n"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    )
    shares = counts.select(*[F.coalesce(F.try_divide(F.col(s), F.col("__n")), F.lit(0.0)).alias(s) for s in SPLITS])
    return shares.unpivot([], list(SPLITS), "split", "proportion")


def id_reconcile(dataset: DataFrame, assignments: DataFrame, key: str = "row_id") -> DataFrame:
    """Every id that only one side has: (side, row_id)."""
    left = dataset.select(F.col(key).alias("__l")).distinct()
    right = assignments.select(F.col(key).alias("__r")).distinct()
    return (
        left.join(right, F.col("__l") == F.col("__r"), "full_outer")
        .filter(F.col("__l").isNull() | F.col("__r").isNull())
        .select(
            F.when(F.col("__r").isNull(), "missing").otherwise("extra").alias("side"),
            F.coalesce("__l", "__r").alias(key),
        )
    )


def split_problems(dataset: DataFrame, assignments: DataFrame, key: str = "row_id") -> DataFrame:
    """Every way the assignments fail to cover the dataset once: (problem, detail)."""
    duplicated = (
        assignments.groupBy(key)
        .count()
        .filter(F.col("count") > 1)
        .select(F.lit("duplicated").alias("problem"), F.col(key).cast("string").alias("detail"))
    )
    unmatched = id_reconcile(dataset, assignments, key).select(
        F.col("side").alias("problem"), F.col(key).cast("string").alias("detail")
    )
    invalid = (
        assignments.filter(~F.col("split").isin(*SPLITS))
        .select(F.lit("invalid label").alias("problem"), F.col("split").alias("detail"))
        .distinct()
    )
    return duplicated.unionByName(unmatched).unionByName(invalid)


def validate_splits(dataset: DataFrame, assignments: DataFrame, key: str = "row_id") -> None:
    found = split_problems(dataset, assignments, key).limit(5).collect()  # examples for the message
    if found:
        raise ValueError("Split assignments do not match the dataset: " + "; ".join(f"{r[0]} {r[1]}" for r in found))


def split_registry(
    spark: SparkSession,
    dataset: DataFrame,
    path: str,
    sizes: Sequence[float] = (0.7, 0.2, 0.1),
    seed: int = 42,
    overwrite: bool = False,
) -> DataFrame:
    """Stored assignments if there are any, else new ones written to ``path``."""

    def stored() -> DataFrame:
        return spark.read.schema(SPLIT_SCHEMA).csv(path, header=True)

    if not overwrite:
        try:
            assignments = stored()
        except AnalysisException:
            assignments = None
        if assignments is not None:
            validate_splits(dataset, assignments)
            return assignments
    random_split(dataset, sizes=sizes, seed=seed).write.mode("overwrite").csv(path, header=True)
    validate_splits(dataset, stored())
    return stored()


def require_unique(df: DataFrame, key: str, what: str) -> None:
    """Fail when a key repeats; reads the key column alone."""
    repeated = df.groupBy(key).count().filter(F.col("count") > 1).limit(1).collect()
    if repeated:
        raise ValueError(f"{what} repeats {key} {repeated[0][0]}.")


def join_splits(dataset: DataFrame, assignments: DataFrame, key: str = "row_id", check: bool = True) -> DataFrame:
    """Inner one-to-one join on the row identifier."""
    if check:
        require_unique(dataset, key, "The dataset")
        require_unique(assignments, key, "The split table")
    return dataset.join(assignments, key)


def require_splits(joined: DataFrame) -> None:
    """Fail when one of the three splits has no rows; one job for all."""
    empty = [r["split"] for r in split_counts(joined).collect() if r["n"] == 0]
    if empty:
        raise ValueError("Splits must be non-empty, and these have no rows: " + ", ".join(empty))


def allotment(counts: Mapping[str, int], n: int, floors: Mapping[str, int]) -> dict[str, int]:
    """Exactly ``n`` rows over the non-empty splits by largest remainder.

    Each split first gets the whole part of its proportional share or its floor, as far as it has rows. What is left
    over goes to the splits furthest below their shares; what is missing is taken from those furthest above, which
    keep one row as long as ``n`` allows. Earlier splits win ties.
    """
    total = sum(counts.values())
    shares = {split: n * size / total for split, size in counts.items() if size}
    taken = {split: min(counts[split], max(int(share), floors.get(split, 0))) for split, share in shares.items()}
    while gap := n - sum(taken.values()):
        step = 1 if gap > 0 else -1
        movable = [s for s in taken if (taken[s] < counts[s] if step > 0 else taken[s] > 1)] or [s for s in taken if taken[s]]
        taken[max(movable, key=lambda s: step * (shares[s] - taken[s]))] += step
    return taken


def stratified_sample(
    joined: DataFrame, n: int | None, seed: int = 42, min_train: int = 2, key: str = "row_id"
) -> DataFrame:
    """Exact sample of ``n`` rows, proportional by split with floors.

    Sizes per split come from three counts; of each split the first rows of the
    shuffled order are taken.
    """
    if n is None:
        return joined
    counts = {r["split"]: r["n"] for r in split_counts(joined).collect()}
    if n >= sum(counts.values()):
        return joined
    sizes = allotment({split: counts[split] for split in SPLITS}, n, dict.fromkeys(SPLITS, 2) | {"train": min_train})
    wanted = F.create_map(*[F.lit(v) for item in sizes.items() for v in item])[F.col("split")].cast("long")
    cuts = {r["split"]: r["cut"] for r in hash_cuts(joined, key, seed, {"cut": lambda _: wanted}, within=["split"]).collect()}
    place, inside = hash_order(seed, key), F.lit(False)
    for split in sizes:
        # A split without a cut is taken whole.
        inside = F.when(F.col("split") == split, _before(place, cuts.get(split))).otherwise(inside)
    return joined.filter(inside)


def extra_pool(joined: DataFrame, sampled: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows that were not sampled."""
    return joined.join(sampled.select(key), key, "left_anti")


def training_sample(
    train: DataFrame,
    features: Sequence[str],
    target: str = "logP47T",
    n: int | None = 10,
    seed: int = 42,
    contract: Contract = Contract(),
) -> DataFrame | None:
    """First ``n`` training rows of the shuffled order, for inspection."""
    if not n or n <= 0:
        return None
    reject_forbidden(features, contract)
    columns = ["row_id", "split", target, *features]
    require_columns(train.columns, columns, "the train split")
    return train.select(*[F.col(f"`{c}`") for c in columns]).orderBy(hash_order(seed, "row_id")).limit(n)


def fold_cuts(ids: DataFrame, k: int, key: str = "row_id", within: Sequence[str] = ()) -> DataFrame:
    """First id of folds 1..k-1 when sorted ids are cut into k blocks.

    The first ``n % k`` blocks are one row longer. Ids may be any integers; the k - 1 ids are selected by counts.
    """
    groups = [f"g{i}" for i in range(len(within))]
    long = ids.select(*[F.col(c).alias(g) for c, g in zip(within, groups)], F.col(key).cast("long").alias("v")).where("v IS NOT NULL")
    base, long_blocks = F.floor(F.col("n") / k), F.col("n") % k
    starts = F.array(*[F.struct(F.lit(i).alias("place"), (base * i + F.least(long_blocks, F.lit(i))).cast("long").alias("rank")) for i in range(1, k)])
    found = order_statistics(long, groups, starts)
    return found.select(*[F.col(g).alias(c) for g, c in zip(groups, within)], F.col("place").alias("fold"), F.col("value").alias("first_id"))


def kfold(df: DataFrame, k: int, key: str = "row_id", name: str = "fold") -> DataFrame:
    """Contiguous blocks in id order, numbered from 0, as unshuffled k-fold does."""
    if k < 2:
        return df.withColumn(name, F.lit(0))
    # k - 1 ids come to the driver; assigning folds is then map-only.
    passed = [(F.col(key) >= r["first_id"]).cast("int") for r in fold_cuts(df, k, key).collect()]
    return df.withColumn(name, sum(passed[1:], passed[0]) if passed else F.lit(0))


def stratified_kfold(df: DataFrame, k: int, label: str, key: str = "row_id", name: str = "fold") -> DataFrame:
    """Contiguous blocks within each class of ``label``."""
    cuts = fold_cuts(df, k, key, within=[label])
    starts = cuts.groupBy(F.col(label).alias("__c")).agg(F.sort_array(F.collect_list("first_id")).alias("__starts"))
    joined = df.join(starts, df[label].eqNullSafe(F.col("__c")), "left")
    fold = F.size(F.filter(F.coalesce("__starts", F.array().cast("array<long>")), lambda s: s <= F.col(key)))
    return joined.withColumn(name, fold).drop("__c", "__starts")


def checked_frame(dataset: DataFrame, assignments: DataFrame) -> DataFrame:
    """Dataset with its splits, after all checks of both."""
    require_unique(dataset, "row_id", "The dataset")
    validate_splits(dataset, assignments)
    return join_splits(dataset, assignments, check=False)


def prepare_frame(
    dataset: DataFrame,
    assignments: DataFrame | None,
    sample_n: int | None = None,
    folds: int = 5,
    seed: int = 42,
    contract: Contract = Contract(),
) -> tuple[DataFrame, list[str]]:
    """Dataset with splits, optionally sampled, and its feature list; without assignments the dataset has its splits."""
    joined = dataset if assignments is None else checked_frame(dataset, assignments)
    if sample_n is not None:
        joined = settle(stratified_sample(joined, sample_n, seed, max(folds, 2)))
    held = ("row_id", contract.target, *(["split"] if assignments is None else []))
    features = [c for c in dataset.columns if c not in held]
    reject_forbidden(features, contract)
    return joined, features
