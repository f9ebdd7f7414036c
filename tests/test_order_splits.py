import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quintil.operators import order, splits


def ids(spark, n, partitions=3):
    return spark.range(n, numPartitions=partitions).select(F.col("id").alias("row_id"))


def shuffled(n, seed=42):
    return sorted(range(n), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_order_rank_is_row_number(spark, partitions):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("k"), F.when(F.col("id") % 3 > 0, "hot").otherwise("b").alias("g"))
    got = order.order_rank(df, ["k"], keys=["g"], partitions=partitions)
    want = df.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy("k")) - 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert [r["row_id"] for r in order.add_row_id(df, ["k"]).orderBy("k").collect()] == list(range(500))


def test_hash_rank_follows_md5(spark):
    got = {r["row_id"]: r["rank"] for r in order.hash_rank(ids(spark, 300), "row_id", 42).collect()}
    assert got == {i: p for p, i in enumerate(shuffled(300))}


def test_running_counts(spark):
    df = spark.createDataFrame([("a", 3.0, 2), ("a", 1.0, 5), ("a", 2.0, 1), ("b", 1.0, 4)], "g string, v double, c long")
    got = {(r["g"], r["v"]): r["before"] for r in order.running_counts(df, "v", "c", ["g"]).collect()}
    assert got == {("a", 1.0): 0, ("a", 2.0): 5, ("a", 3.0): 6, ("b", 1.0): 0}


@pytest.mark.parametrize("n", [3, 7, 100, 1000])
def test_random_split_is_exact_and_stable(spark, n):
    got = {r["row_id"]: r["split"] for r in splits.random_split(ids(spark, n)).collect()}
    again = {r["row_id"]: r["split"] for r in splits.random_split(ids(spark, n, 8), digits=1).collect()}
    assert got == again and len(got) == n
    train, test = round(n * 0.7), round(n * 0.2)
    expected = {i: "train" if p < train else "test" if p < train + test else "validation" for p, i in enumerate(shuffled(n))}
    assert got == expected


def test_split_sizes_must_sum_to_one(spark):
    with pytest.raises(ValueError, match="sum to 1"):
        splits.random_split(ids(spark, 10), sizes=(0.7, 0.2, 0.2))


def test_nested_split_sizes(spark):
    counts = {r["split"]: r["n"] for r in splits.split_counts(splits.nested_split(ids(spark, 101))).collect()}
    assert counts == {"validation": 11, "test": math.ceil(90 * 2 / 9), "train": 70}


@pytest.mark.parametrize(("n", "k"), [(997, 3), (10, 5), (7, 3), (3, 3)])
def test_kfold_blocks(spark, n, k):
    df = ids(spark, n).select((F.col("row_id") * 5 + 11).alias("row_id"))
    rows = splits.kfold(df, k).orderBy("row_id").collect()
    want = np.concatenate([[f] * len(b) for f, b in enumerate(np.array_split(np.arange(n), k))])
    assert [r["fold"] for r in rows] == want.tolist()


def test_stratified_kfold(spark):
    df = ids(spark, 40).withColumn("c", (F.col("row_id") % 4 == 0).cast("int"))
    got = splits.stratified_kfold(df, 5, "c").groupBy("c", "fold").count().collect()
    assert {(r["c"], r["fold"]): r["count"] for r in got} == {(c, f): (6, 2)[c] for c in (0, 1) for f in range(5)}


@pytest.mark.parametrize("size", [10, 57, 32, 5])
def test_stratified_sample_is_exact(spark, size):
    df = ids(spark, 200)
    joined = df.join(splits.random_split(df), "row_id")
    sample = splits.stratified_sample(joined, size)
    assert sample.count() == size and sample.select("row_id").distinct().count() == size
    counts = {r["split"]: r["n"] for r in splits.split_counts(sample).collect()}
    assert counts["train"] >= 2 and counts["test"] >= 1 and counts["validation"] >= 1
    assert splits.extra_pool(joined, sample).count() == 200 - size
    assert splits.stratified_sample(joined, 500).count() == 200


def test_validate_splits(spark):
    df = ids(spark, 100)
    good = splits.random_split(df)
    splits.validate_splits(df, good)
    with pytest.raises(ValueError, match="missing"):
        splits.validate_splits(df, good.filter("row_id <> 5"))
    with pytest.raises(ValueError, match="extra"):
        splits.validate_splits(df.filter("row_id <> 5"), good)
    with pytest.raises(ValueError, match="duplicated"):
        splits.validate_splits(df, good.union(good.limit(1)))
    with pytest.raises(ValueError, match="invalid label"):
        splits.validate_splits(df, good.withColumn("split", F.when(F.col("row_id") == 1, "holdout").otherwise(F.col("split"))))
    with pytest.raises(ValueError, match="repeats"):
        splits.join_splits(df.union(df.limit(1)), good)


def test_registry_reuses_assignments(spark, tmp_path):
    path = str(tmp_path / "splits")
    df = ids(spark, 50)
    first = sorted(map(tuple, splits.split_registry(spark, df, path).collect()))
    assert sorted(map(tuple, splits.split_registry(spark, df, path, seed=7).collect())) == first
    assert sorted(map(tuple, splits.split_registry(spark, df, path, seed=7, overwrite=True).collect())) != first


def test_proportions_and_empty_splits(spark):
    got = {r["split"]: r["proportion"] for r in splits.split_proportions(splits.random_split(ids(spark, 1000))).collect()}
    assert got == {"train": 0.7, "test": 0.2, "validation": 0.1}
    only = ids(spark, 5).withColumn("split", F.lit("train"))
    assert {r["split"]: r["n"] for r in splits.split_counts(only).collect()} == {"train": 5, "test": 0, "validation": 0}
    with pytest.raises(ValueError, match="test, validation"):
        splits.require_splits(only)


def test_training_sample(spark):
    train = ids(spark, 30).select("row_id", F.lit("train").alias("split"), F.lit(1.0).alias("logP47T"), F.lit(2).alias("x"))
    sample = splits.training_sample(train, ["x"])
    assert sample.count() == 10 and sample.columns == ["row_id", "split", "logP47T", "x"]
    assert {r["row_id"] for r in sample.collect()} == set(shuffled(30)[:10])
    assert splits.training_sample(train, ["x"], n=0) is None
    with pytest.raises(ValueError, match="Forbidden"):
        splits.training_sample(train.withColumn("P47T", F.lit(1)), ["x", "P47T"])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 11, 40, 149])
def test_allotment_is_exact(n):
    counts = {"train": 100, "test": 40, "validation": 10}
    got = splits.allotment(counts, n, {"train": 5, "test": 2, "validation": 2})
    assert sum(got.values()) == n and all(0 <= got[s] <= counts[s] for s in got)
    assert n < 9 or (got["train"] >= 5 and got["test"] >= 2 and got["validation"] >= 2)


def test_random_split_refuses_repeated_ids(spark):
    with pytest.raises(ValueError, match="repeats"):
        splits.random_split(spark.createDataFrame([(1,)] * 10, "row_id long"))


def test_kfold_of_hashed_ids_and_of_an_outlier(spark):
    hashed = spark.range(100).select(F.xxhash64("id").alias("row_id"))
    far = spark.range(99).select(F.col("id").alias("row_id")).union(spark.createDataFrame([((1 << 62),)], "row_id long"))
    for df in (hashed, far):
        folds = [r["fold"] for r in splits.kfold(df, 3).orderBy("row_id").collect()]
        assert folds == [0] * 34 + [1] * 33 + [2] * 33


def test_every_problem_is_listed(spark):
    found = splits.split_problems(spark.range(30).select(F.col("id").alias("row_id")), spark.createDataFrame([], "row_id long, split string"))
    assert found.count() == 30
