import pytest
from pyspark.sql import functions as F

from quintil.operators import effects, permute


def geo(spark):
    """30 people in three agglomerates and two regions, with one rank value per area."""
    rows = [(i, f"A{i % 3}", f"R{i % 2}", (0.1, 0.5, 0.9)[i % 3], (0.2, 0.8)[i % 2], 2022, i % 4) for i in range(30)]
    return spark.createDataFrame(rows, "row_id long, AGLOMERADO string, Region string, AGLO_rk double, Reg_rk double, ANO4 int, TRIMESTRE int")


@pytest.mark.parametrize("seed", [1, 2, 3, 42])
def test_group_values_move_between_groups(spark, seed):
    out, _ = permute.group_permutation(geo(spark), "AGLO_rk", "AGLOMERADO", seed)
    pairs = {tuple(r) for r in out.select("AGLOMERADO", "AGLO_rk").distinct().collect()}
    assert out.count() == 30 and len(pairs) == 3
    assert {v for _, v in pairs} == {0.1, 0.5, 0.9}
    assert pairs != {("A0", 0.1), ("A1", 0.5), ("A2", 0.9)}


def test_two_groups_always_swap(spark):
    for seed in range(6):
        out, _ = permute.group_permutation(geo(spark), "Reg_rk", "Region", seed)
        assert {tuple(r) for r in out.select("Region", "Reg_rk").distinct().collect()} == {("R0", 0.8), ("R1", 0.2)}


def test_permuted_values_are_a_permutation(spark):
    rows = permute.permuted_values(geo(spark), "AGLO_rk", "AGLOMERADO", 5).collect()
    assert sorted(r["value"] for r in rows) == sorted(r["permuted"] for r in rows) and any(r["value"] != r["permuted"] for r in rows)


def test_one_group_missing_group_and_missing_column(spark):
    df = spark.createDataFrame([(1, None, 5), (2, None, 6), (3, None, 6)], "row_id long, g string, v int")
    out, mapping = permute.group_permutation(df, "v", "g")
    assert {r["v"] for r in out.collect()} == {6} and mapping.first()["n_values"] == 2
    same, note = permute.group_permutation(df, "absent", "g")
    assert same is df and "absent" in note.first()[0]


def test_mode_ties_take_the_lowest_text(spark):
    df = spark.createDataFrame([("a", 10), ("a", 9), ("b", None), ("b", None), ("b", 1)], "g string, v int")
    got = {r["g"]: (r["value"], r["n_values"]) for r in permute.group_mode(df, "g", "v").collect()}
    assert got == {"a": (10, 2), "b": (None, 2)}


@pytest.mark.parametrize("dense", [True, False])
def test_row_permutation_moves_blocks_together(spark, dense):
    df = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("a"), (F.col("id") * 3).alias("b"), F.col("id").alias("kept"))
    rows = permute.row_permutation(df, ["a", "b"], 7, dense_key=dense).collect()
    assert sorted(r["a"] for r in rows) == [2 * i for i in range(100)]
    assert all(r["a"] * 3 == r["b"] * 2 and r["kept"] == r["row_id"] for r in rows)
    assert any(r["a"] != 2 * r["row_id"] for r in rows)


def test_fixed_effects(spark):
    df, features, facts = effects.apply_fixed_effects(geo(spark), ["Region"], [{"name": "geo fe", "columns": ["Region", "TRIMESTRE"], "max_levels": 8}])
    assert features == ["Region", "fe_geo-fe"] and facts[0]["n_levels"] == 4
    assert df.select("`fe_geo-fe`").first()[0] == "R0__0"
    with pytest.raises(ValueError, match="exceeding max_levels=2"):
        effects.apply_fixed_effects(geo(spark), [], [{"name": "x", "columns": ["AGLOMERADO"], "max_levels": 2}])
    with pytest.raises(ValueError, match="one or two columns"):
        effects.apply_fixed_effects(geo(spark), [], [{"name": "x", "columns": ["AGLOMERADO", "Region", "ANO4"], "max_levels": 9}])
    with pytest.raises(ValueError, match="missing"):
        effects.apply_fixed_effects(geo(spark), [], [{"name": "x", "columns": ["nope"], "max_levels": 9}])
    with pytest.raises(ValueError, match="positive max_levels"):
        effects.apply_fixed_effects(geo(spark), [], [{"name": "x", "columns": ["Region"]}])


def test_view_keeps_the_frame(spark):
    viewed, kept, facts = effects.apply_view(geo(spark), ["Region", "AGLO_rk"], "clean", ["AGLO_rk", "Reg_rk"])
    assert kept == ["Region"] and "AGLO_rk" in viewed.columns
    assert facts["dropped_columns_present"] == ["AGLO_rk"] and facts["dropped_columns_missing"] == ["Reg_rk"]
    with pytest.raises(ValueError, match="leak the target"):
        effects.apply_view(geo(spark), ["P47T"])
