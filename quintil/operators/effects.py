"""Feature views and fixed effects."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintil.contract import Contract, reject_forbidden
from quintil.functions.scalar import level_text
from quintil.operators.permute import group_permutation


def apply_view(
    df: DataFrame,
    features: Sequence[str],
    name: str | None = None,
    drop_columns: Sequence[str] = (),
    permute_group_values: Sequence[Mapping[str, object]] = (),
    contract: Contract = Contract(),
) -> tuple[DataFrame, list[str], dict[str, object]]:
    """A feature view: the frame with permuted group values, and the shorter feature list.

    A dropped feature stays in the frame, where permutations may still group by it.
    """
    dropped, offered = list(map(str, drop_columns)), set(features)
    remaining = [feature for feature in features if feature not in dropped]
    reject_forbidden(remaining, contract)
    moves = [(str(m["column"]), str(m["group_by"]), int(m.get("random_state", 42))) for m in permute_group_values]
    viewed = reduce(lambda frame, move: group_permutation(frame, *move)[0], moves, df)
    found = {True: [], False: []}
    for column in dropped:
        found[column in offered].append(column)
    columns, groups = ([move[i] for move in moves] for i in (0, 1))
    facts = dict(
        name=name,
        drop_columns=dropped,
        dropped_columns_present=found[True],
        dropped_columns_missing=found[False],
        permuted_columns=columns,
        group_by_columns=groups,
    )
    return viewed, remaining, facts


def effect_column(name: str) -> str:
    return "fe_" + (re.sub(r"[^A-Za-z0-9_.-]+", "-", name).strip("-") or "run")


@dataclass(frozen=True)
class FixedEffect:
    """One effect: the level column made of one or two columns, and how many levels it may have."""

    name: str
    columns: tuple[str, ...]
    max_levels: int
    drop_first: bool

    @classmethod
    def read(cls, place: int, given: Mapping[str, object]) -> FixedEffect:
        name = given.get("name") or f"fixed_effect_{place}"
        return cls(str(name), tuple(map(str, given.get("columns") or ())), int(given.get("max_levels", 0)), bool(given.get("drop_first", False)))

    @property
    def column(self) -> str:
        return effect_column(self.name)

    def faults(self, present: set[str], features: set[str]) -> list[str]:
        """What keeps the effect from being built on a frame with these columns."""
        found = []
        if len(self.columns) not in (1, 2):
            found.append(f"is made of one or two columns, not of {len(self.columns)}")
        if absent := [c for c in self.columns if c not in present]:
            found.append(f"names columns missing from the table: {', '.join(absent)}")
        if self.max_levels < 1:
            found.append("sets no positive max_levels")
        if self.column in present - features:
            found.append(f"would overwrite {self.column}, which is no feature")
        return [f"{self.name} {text}" for text in found]

    def facts(self, n_levels: int) -> dict[str, object]:
        return {
            "fe_name": self.name,
            "source_columns": list(self.columns),
            "generated_column": self.column,
            "max_levels": self.max_levels,
            "drop_first": self.drop_first,
            "n_levels": n_levels,
        }


def apply_fixed_effects(
    df: DataFrame, features: Sequence[str], effects: Sequence[Mapping[str, object]], contract: Contract = Contract()
) -> tuple[DataFrame, list[str], list[dict[str, object]]]:
    """The frame with a level column for each effect, the longer feature list, and what was built.

    All faults are reported together; levels are counted in one job for all effects.
    """
    wanted = [FixedEffect.read(place, given) for place, given in enumerate(effects, start=1)]
    faults = [fault for effect in wanted for fault in effect.faults(set(df.columns), set(features))]
    if faults:
        raise ValueError("Fixed effects cannot be built: " + "; ".join(faults))
    longer = list(dict.fromkeys([*features, *(effect.column for effect in wanted)]))
    reject_forbidden(longer, contract)
    if not wanted:
        return df, longer, []
    framed = df.withColumns({effect.column: level_text(*effect.columns) for effect in wanted})
    counted = {row["fe_name"]: row["n_levels"] for row in level_counts(framed, [e.facts(0) for e in wanted]).collect()}
    facts = [effect.facts(counted[effect.name]) for effect in wanted]
    crowded = [f"{f['fe_name']} ({f['n_levels']} levels, exceeding max_levels={f['max_levels']})" for f in facts if f["n_levels"] > f["max_levels"]]
    if crowded:
        raise ValueError("Fixed effects have more levels than allowed: " + ", ".join(crowded))
    return framed, longer, facts


def level_counts(df: DataFrame, facts: Sequence[Mapping[str, object]]) -> DataFrame:
    """Distinct levels per effect: (fe_name, n_levels, max_levels, within_cap)."""
    entries = F.array(
        *[
            F.struct(
                F.lit(f["fe_name"]).alias("fe_name"),
                F.lit(f["max_levels"]).alias("max_levels"),
                F.col(f"`{f['generated_column']}`").alias("level"),
            )
            for f in facts
        ]
    )
    # Distinct combines map-side, so a hot level costs one row per task.
    distinct = df.select(F.explode(entries).alias("e")).select("e.*").distinct()
    return distinct.groupBy("fe_name", "max_levels").agg(F.count("level").alias("n_levels")).select(
        "fe_name", "n_levels", "max_levels", (F.col("n_levels") <= F.col("max_levels")).alias("within_cap")
    )
