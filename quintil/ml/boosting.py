"""Gradient boosting over distributed histograms, one leaf at a time.

Rows are coded once (a numeric value by its bin, a level by its number) and kept in blocks of coded columns. A pass sums
gradients, curvatures and counts of the wanted leaves by feature and bin in each partition, and the sums of a (leaf, feature)
meet in one group, which gives its best split back. The driver sees one row per leaf and feature; only small sums
of few partitions, whose size is checked, it adds itself.

A tree grows best-first: the leaf of largest gain is split next, until the leaves are used up. With ``r`` splits left only
the ``r`` leaves of largest gain can be split at all, so one pass looks below all of these at once; a tree takes as many
passes as it is deep, not as many as it has leaves, and is the tree that single steps would give.

A level is split from all others, as its one-hot slot would be, without a vector of slots, so the number of levels is free.
Ties go to the first feature, then to the first bin; of equal leaves the older one is split.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quintil.ml.design import Preparation, prepare
from quintil.session import settle

MAX_BINS = 255
REFRESH = 10  # trees after which the rows' predictions are written
LEAST_CURVATURE = 1e-3
DIRECT_BYTES = 16 << 20
BLOCK_SCHEMA = "n long, codes binary, y binary, held binary, raw binary"
SPLIT_SCHEMA = "leaf int, feature int, gain double, cut int, left array<double>, right array<double>, whole array<double>"


@dataclass(frozen=True)
class Settings:
    learning_rate: float = 0.1
    max_iter: int = 100
    max_leaf_nodes: int | None = 31
    max_depth: int | None = None
    min_samples_leaf: int = 20
    l2_regularization: float = 0.0
    early_stopping: bool | str = False  # "auto" stops early from 10,000 rows on
    validation_fraction: float = 0.1
    n_iter_no_change: int = 10
    tol: float = 1e-7
    subsample: float = 1.0
    colsample: float = 1.0
    loss: str = "squared"  # or "log"
    seed: int = 42


@dataclass
class Tree:
    """Arrays over nodes; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def place(self, codes: np.ndarray, is_level: np.ndarray) -> np.ndarray:
        """Number of the leaf of each row."""
        node = np.zeros(len(codes), np.int64)
        rows = np.arange(len(codes))
        while len(rows):
            at = node[rows]
            feature = self.feature[at]
            inner = feature >= 0
            rows, at, feature = rows[inner], at[inner], feature[inner]
            code = codes[rows, feature]
            goes_left = np.where(is_level[feature], code == self.cut[at], code <= self.cut[at])
            node[rows] = np.where(goes_left, self.left[at], self.right[at])
        return node


@dataclass
class Encoder:
    """Codes of the prepared features: bins of the numeric ones, then numbers of the levels."""

    preparation: Preparation
    edges: list[np.ndarray] = field(default_factory=list)

    @property
    def is_level(self) -> np.ndarray:
        return np.r_[np.zeros(len(self.preparation.numeric), bool), np.ones(len(self.preparation.categorical), bool)]

    @property
    def sizes(self) -> list[int]:
        """Codes of each feature; the last code of a categorical one is that of unknown levels."""
        levels = [len(self.preparation.levels[c]) + 1 for c in self.preparation.categorical]
        return [len(e) + 1 for e in self.edges] + levels

    def columns(self) -> list:
        p = self.preparation
        return [p.number(c).alias(f"__number_{i}") for i, c in enumerate(p.numeric)] + [p.text(c).alias(f"__text_{i}") for i, c in enumerate(p.categorical)]

    def codes(self, arrays: Sequence[pa.Array], rows: int) -> np.ndarray:
        columns = [np.searchsorted(e, a.to_numpy(zero_copy_only=False), side="left") for e, a in zip(self.edges, arrays)]
        for column, values in zip(self.preparation.categorical, arrays[len(self.edges) :]):
            levels = self.preparation.levels[column]
            found = pc.index_in(values, value_set=pa.array(levels, pa.string()))
            columns.append(pc.fill_null(found, len(levels)).to_numpy(zero_copy_only=False))
        kind = np.uint16 if max(self.sizes, default=1) <= 1 << 16 else np.int32
        return np.stack(columns, axis=1).astype(kind) if columns else np.empty((rows, 0), kind)


def fit_encoder(train: DataFrame, features: Sequence[str], categorical: Sequence[str] = ()) -> Encoder:
    """Medians, modes, levels and bins: midpoints of the values if there are few of them, else quantiles."""
    prepared = prepare(train, features, categorical, max_levels=None)
    encoder = Encoder(prepared)
    width = len(prepared.numeric)
    if not width:
        return encoder

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray | None] = [np.empty(0)] * width
        for batch in batches:
            for i, now in enumerate(held):
                if now is not None:
                    now = np.union1d(now, batch.column(i).to_numpy(zero_copy_only=False))
                    held[i] = now if len(now) <= MAX_BINS else None
        yield pa.RecordBatch.from_pydict(
            {"i": pa.array(range(width), pa.int32()), "many": pa.array([v is None for v in held]), "values": pa.array([[] if v is None else v for v in held], pa.list_(pa.float64()))}
        )

    values = train.select(*encoder.columns()[:width])
    seen = values.mapInArrow(few, "i int, many boolean, values array<double>").groupBy("i")
    seen = seen.agg(F.max("many").alias("many"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))).alias("values"))
    # At most MAX_BINS values a feature and partition reach a group, and as many or none a feature the driver.
    rows = {r.i: r for r in seen.select("i", (F.col("many") | (F.size("values") > MAX_BINS)).alias("many"), F.slice("values", 1, MAX_BINS).alias("values")).collect()}
    wide = [i for i in range(width) if rows[i].many]
    cuts = {}
    if wide:
        probs = [k / MAX_BINS for k in range(1, MAX_BINS)]
        found = values.agg(*[F.percentile_approx(f"__number_{i}", probs, 20 * MAX_BINS).alias(f"q{i}") for i in wide]).first()
        cuts = {i: np.unique(found[f"q{i}"]) for i in wide}
    for i in range(width):
        distinct = np.array(rows[i].values, float)
        encoder.edges.append(cuts[i] if i in cuts else (distinct[1:] + distinct[:-1]) / 2)
    return encoder


def blocks_of(df: DataFrame, encoder: Encoder, target: str, held_fraction: float = 0.0, seed: int = 42) -> DataFrame:
    """Coded rows in blocks, written; rows without a target are left out. A share may be held out by a hash of the row."""
    label = F.col(f"`{target}`").cast("double")
    inputs = encoder.columns()
    drawn = F.pmod(F.xxhash64(*inputs, label, F.lit(seed)), F.lit(1_000_000)) < int(held_fraction * 1_000_000)
    rows = df.where(label.isNotNull()).select(*inputs, label.alias("y"), drawn.alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = encoder.codes(batch.columns[:-2], batch.num_rows)
                y = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
                held = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.uint8)
                yield _block(codes, y, held, np.zeros(len(y)))

    return settle(rows.mapInArrow(run, BLOCK_SCHEMA))


def _block(codes: np.ndarray, y: np.ndarray, held: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
    blobs = [pa.array([a.tobytes()], pa.binary()) for a in (codes, y.astype(float), held, raw)]
    return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64()), *blobs], ["n", "codes", "y", "held", "raw"])


def _opened(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for n, codes, y, held, raw in zip(*(c.to_pylist() for c in batch.columns)):
            kind = np.int32 if features and len(codes) == 4 * n * features else np.uint16
            yield np.frombuffer(codes, kind).reshape(n, features), np.frombuffer(y), np.frombuffer(held, np.uint8), np.frombuffer(raw)


@dataclass
class Booster:
    """Trees with their start value; predictions are on the scale of the target, or log-odds for the log loss."""

    encoder: Encoder
    settings: Settings
    base: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[tuple[float, float]] = field(default_factory=list)  # (train, held out) before each tree

    def raw(self, codes: np.ndarray, trees: Sequence[Tree] | None = None) -> np.ndarray:
        out = np.zeros(len(codes)) if trees is not None else np.full(len(codes), self.base)
        for tree in self.trees if trees is None else trees:
            out += tree.value[tree.place(codes, self.encoder.is_level)]
        return out

    def scored(self, blocks: DataFrame) -> DataFrame:
        """(label, prediction) of every coded row."""
        width = len(self.encoder.sizes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for codes, y, _, _ in _opened(batches, width):
                yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(self.raw(codes))], ["label", "prediction"])

        return blocks.mapInArrow(run, "label double, prediction double")

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with ``y_pred``, and for the log loss with the probability ``score``."""
        encoder, names = self.encoder, df.columns
        kept = StructType(list(df.schema.fields)).add("y_pred", "double")
        log = self.settings.loss == "log"
        if log:
            kept = kept.add("score", "double")
        inputs = encoder.columns()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = len(names)
                codes = encoder.codes(batch.columns[n:], batch.num_rows)
                raw = self.raw(codes)
                new = [pa.array((raw > 0).astype(float)), pa.array(1 / (1 + np.exp(-raw)))] if log else [pa.array(raw)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *new], [*names, "y_pred", *(["score"] if log else [])])

        return df.select(*[F.col(f"`{c}`") for c in names], *inputs).mapInArrow(run, kept)

    def staged_errors(self, blocks: DataFrame) -> list[float]:
        """Mean squared error after each tree, all in one pass."""
        width = len(self.encoder.sizes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, rows = np.zeros(len(self.trees)), 0
            for codes, y, _, _ in _opened(batches, width):
                now = np.full(len(y), self.base)
                for i, tree in enumerate(self.trees):
                    now += tree.value[tree.place(codes, self.encoder.is_level)]
                    sums[i] += ((y - now) ** 2).sum()
                rows += len(y)
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(sums)), pa.int32()), "s": pa.array(sums), "n": pa.array([rows] * len(sums), pa.int64())})

        found = blocks.mapInArrow(run, "i int, s double, n long").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("mse")).collect()
        return [r.mse for r in sorted(found)]


def _slopes(loss: str, y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if loss == "squared":
        return raw - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-raw))
    return p - y, p * (1 - p)


def _loss(loss: str, y: np.ndarray, raw: np.ndarray) -> np.ndarray:
    return (y - raw) ** 2 / 2 if loss == "squared" else np.logaddexp(0, raw) - y * raw


def best_split(g: np.ndarray, h: np.ndarray, c: np.ndarray, level: bool, least: int, l2: float) -> tuple[float, int, list[float], list[float]] | None:
    """(gain, cut, left sums, right sums) of the best split of one feature's histogram."""
    if level:
        left = np.stack([g, h, c])[:, :-1]
    else:
        left = np.cumsum(np.stack([g, h, c]), axis=1)[:, :-1]
    whole = np.array([g.sum(), h.sum(), c.sum()])
    right = whole[:, None] - left
    allowed = (left[2] >= least) & (right[2] >= least) & (left[1] >= LEAST_CURVATURE) & (right[1] >= LEAST_CURVATURE)
    if not allowed.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        before = whole[0] ** 2 / (whole[1] + l2)
        gain = np.where(allowed, left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - before, -np.inf)
    cut = int(np.argmax(gain))
    # Rounding alone is no gain.
    if gain[cut] <= 1e-12 * max(1.0, abs(before)):
        return None
    return float(gain[cut]), cut, left[:, cut].tolist(), right[:, cut].tolist()


@dataclass
class _Node:
    sums: Sequence[float]
    depth: int
    split: tuple | None = None  # (gain, feature, cut, left sums, right sums)
    children: tuple[int, int] | None = None
    final: bool = False  # its split is part of the tree


class _Growth:
    """One tree while it grows."""

    def __init__(self, booster: Booster, features: np.ndarray, direct: int) -> None:
        self.booster, self.settings, self.features, self.direct = booster, booster.settings, features, direct
        self.nodes: list[_Node] = []

    def arrays(self, committed: bool) -> Tree:
        """The tree of the committed splits, or of all that were looked below."""
        n = len(self.nodes)
        tree = Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n))
        for i, node in enumerate(self.nodes):
            if node.children and (node.final or not committed):
                tree.feature[i], tree.cut[i] = node.split[1], node.split[2]
                tree.left[i], tree.right[i] = node.children
            tree.value[i] = -self.settings.learning_rate * node.sums[0] / (node.sums[1] + self.settings.l2_regularization) if node.sums[1] > 0 else 0.0
        return tree

    def branch(self, number: int) -> list[int]:
        node = self.nodes[number]
        if node.children is None:
            node.children = (len(self.nodes), len(self.nodes) + 1)
            self.nodes += [_Node(node.split[3], node.depth + 1), _Node(node.split[4], node.depth + 1)]
        return list(node.children)

    def worth_a_look(self, number: int) -> bool:
        node, s = self.nodes[number], self.settings
        return (s.max_depth is None or node.depth < s.max_depth) and node.sums[2] >= 2 * s.min_samples_leaf

    def order(self, frontier: list[int]) -> list[int]:
        return sorted((i for i in frontier if self.nodes[i].split), key=lambda i: (-self.nodes[i].split[0], i))

    def grow(self, state: DataFrame, pending: Sequence[Tree], iteration: int) -> tuple[Tree, tuple[float, ...]]:
        """The tree, and the losses before it."""
        self.nodes = [_Node((0.0, 0.0, 0.0), 0)]
        loss = self.look(state, pending, [0], iteration, True)
        frontier, leaves = [0], 1
        budget = self.settings.max_leaf_nodes or 1 << 31
        looked: set[int] = {0}
        while leaves < budget:
            ranked = self.order(frontier)
            if not ranked:
                break
            below = [c for i in ranked[: budget - leaves - 1] for c in self.branch(i)]
            fresh = [c for c in below if c not in looked and self.worth_a_look(c)]
            looked.update(below)
            if fresh:
                self.look(state, pending, fresh, iteration, False)
            while leaves < budget:
                ranked = self.order(frontier)
                if not ranked:
                    break
                children = self.branch(ranked[0])
                if leaves + 1 < budget and children[0] not in looked:
                    break
                self.nodes[ranked[0]].final = True
                frontier.remove(ranked[0])
                frontier += children
                leaves += 1
        return self.arrays(committed=True), loss

    def look(self, state: DataFrame, pending: Sequence[Tree], wanted: list[int], iteration: int, with_loss: bool) -> tuple[float, ...]:
        """Best splits of the wanted leaves, from one pass over the rows."""
        booster, s, features = self.booster, self.settings, self.features
        sizes, is_level = booster.encoder.sizes, booster.encoder.is_level
        tree, base = self.arrays(committed=False), booster.base
        slot = np.full(len(self.nodes), -1)
        slot[wanted] = np.arange(len(wanted))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = {f: np.zeros((3, len(wanted) * sizes[f])) for f in features}
            loss = np.zeros(4)
            for codes, y, held, raw in _opened(batches, len(sizes)):
                now = raw + base + booster.raw(codes, pending)
                if with_loss:
                    each = _loss(s.loss, y, now)
                    loss += [each[held == 0].sum(), (held == 0).sum(), each[held == 1].sum(), (held == 1).sum()]
                at = slot[tree.place(codes, is_level)]
                used = (at >= 0) & (held == 0)
                if s.subsample < 1.0:
                    rng = np.random.default_rng([s.seed, iteration, len(y), int(np.abs(y[:64]).sum() * 1e6) & 0xFFFFFFFF])
                    used &= rng.random(len(y)) < s.subsample
                g, h = _slopes(s.loss, y[used], now[used])
                at, codes = at[used], codes[used]
                for f in features:
                    cell = at * sizes[f] + codes[:, f]
                    for row, weights in enumerate((g, h, None)):
                        totals[f][row] += np.bincount(cell, weights, minlength=totals[f].shape[1])
            rows = []
            for f, values in totals.items():
                by_leaf = values.reshape(3, len(wanted), sizes[f])
                rows += [(leaf, int(f), by_leaf[:, i].tobytes()) for i, leaf in enumerate(wanted) if by_leaf[2, i].any()]
            if with_loss:
                rows.append((-1, -1, loss.tobytes()))
            names = ["leaf", "feature", "sums"]
            columns = list(zip(*rows)) if rows else [[], [], []]
            kinds = (pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def decided(leaf: int, feature: int, payloads: list[bytes]) -> dict:
            # In a fixed order, so that a repeated run adds the same numbers the same way.
            total = sum(np.frombuffer(p) for p in sorted(payloads))
            if leaf < 0:
                row = (leaf, feature, None, None, None, None, total.tolist())
            else:
                g, h, c = total.reshape(3, -1)
                found = best_split(g, h, c, bool(is_level[feature]), s.min_samples_leaf, s.l2_regularization)
                whole = [g.sum(), h.sum(), c.sum()]
                row = (leaf, feature, *(found or (None, None, None, None)), whole)
            return dict(zip(("leaf", "feature", "gain", "cut", "left", "right", "whole"), row))

        def decide(table: pa.Table) -> pa.Table:
            row = decided(table.column("leaf")[0].as_py(), table.column("feature")[0].as_py(), table.column("sums").to_pylist())
            return pa.Table.from_pylist([row], DECIDED)

        partial = state.mapInArrow(sums, "leaf int, feature int, sums binary")
        if self.direct >= 24 * len(wanted) * sum(sizes[f] for f in features):
            rows = partial.toArrow().to_pylist()
            met: dict[tuple[int, int], list] = {}
            for r in rows:
                met.setdefault((r["leaf"], r["feature"]), []).append(r["sums"])
            found = [decided(*place, payloads) for place, payloads in met.items()]
        else:
            found = [r.asDict() for r in partial.groupBy("leaf", "feature").applyInArrow(decide, SPLIT_SCHEMA).collect()]
        loss = (0.0, 0.0, 0.0, 0.0)
        for r in sorted(found, key=lambda r: (r["leaf"], r["feature"])):
            if r["leaf"] < 0:
                loss = tuple(r["whole"])
                continue
            node = self.nodes[r["leaf"]]
            node.sums = r["whole"]
            if r["gain"] is not None and (node.split is None or r["gain"] > node.split[0]):
                node.split = (r["gain"], r["feature"], r["cut"], r["left"], r["right"])
        return loss


DECIDED = pa.schema(
    [("leaf", pa.int32()), ("feature", pa.int32()), ("gain", pa.float64()), ("cut", pa.int32())]
    + [(n, pa.list_(pa.float64())) for n in ("left", "right", "whole")]
)


def _advanced(state: DataFrame, booster: Booster, pending: Sequence[Tree]) -> DataFrame:
    """The rows with the pending trees in their predictions, written."""
    width = len(booster.encoder.sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, y, held, raw in _opened(batches, width):
            yield _block(codes, y, held, raw + booster.raw(codes, pending))

    return settle(state.mapInArrow(run, BLOCK_SCHEMA))


def fit_blocks(blocks: DataFrame, encoder: Encoder, settings: Settings, direct_bytes: int = DIRECT_BYTES) -> Booster:
    """Boost over coded rows; rows marked as held out steer early stopping only.

    Sums of a pass that have at most ``direct_bytes`` in all partitions together are added on the driver, which saves a
    shuffle; the splits are the same either way.
    """
    if settings.loss not in ("squared", "log"):
        raise ValueError(f"Unknown loss {settings.loss!r}.")
    width = len(encoder.sizes)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total, held_rows = 0, 0.0, 0
        for _, y, held, _ in _opened(batches, width):
            rows += int((held == 0).sum())
            held_rows += int((held == 1).sum())
            total += float(y[held == 0].sum())
        yield pa.RecordBatch.from_pydict({"n": [rows], "s": [total], "held": [held_rows]})

    n, total, held = blocks.mapInArrow(start, "n long, s double, held long").agg(F.sum("n"), F.sum("s"), F.sum("held")).first()
    mean = total / n if n else 0.0
    if settings.loss == "log":
        if n and not 0.0 < mean < 1.0:
            raise ValueError("A classifier needs rows of both classes, 0 and 1.")
        mean = float(np.log(mean / (1 - mean))) if n else 0.0
    booster = Booster(encoder, settings, mean)
    partitions = max(1, blocks.rdd.getNumPartitions())
    stops = bool(held)
    state, pending = blocks, []
    rng = np.random.default_rng(settings.seed)
    scores: list[float] = []
    for iteration in range(settings.max_iter if n else 0):
        count = max(1, round(settings.colsample * width))
        features = np.sort(rng.choice(width, count, replace=False)) if count < width else np.arange(width)
        tree, loss = _Growth(booster, features, direct_bytes // partitions).grow(state, pending, iteration)
        booster.losses.append((loss[0] / max(loss[1], 1), loss[2] / max(loss[3], 1)))
        if stops:
            scores.append(-booster.losses[-1][1])
            wait = settings.n_iter_no_change
            if len(scores) > wait and all(v <= scores[-wait - 1] + settings.tol for v in scores[-wait:]):
                break
        if (tree.feature < 0).all() and settings.subsample >= 1.0 and count == width:
            break  # no split gains anything, so none will
        booster.trees.append(tree)
        pending.append(tree)
        if len(pending) == REFRESH:
            state, pending = _advanced(state, booster, pending), []
    return booster


def fit(train: DataFrame, features: Sequence[str], target: str, settings: Settings, categorical: Sequence[str] = ()) -> Booster:
    """Encoder and trees of a training table."""
    encoder = fit_encoder(train, features, categorical)
    return fit_blocks(blocks_of(train, encoder, target, held_share(train, settings), settings.seed), encoder, settings)


def held_share(train: DataFrame, settings: Settings) -> float:
    """Share of the rows that steer early stopping."""
    wanted = train.count() > 10_000 if settings.early_stopping == "auto" else bool(settings.early_stopping)
    return settings.validation_fraction if wanted else 0.0


def boost_bins(n: np.ndarray, total: np.ndarray, level: bool, settings: Settings) -> np.ndarray:
    """Prediction of each bin of a single feature, from its rows and the sum of their targets.

    With one feature all rows of a bin share a prediction, so the bins stand for the rows in every step.
    """
    raw = np.full(len(n), total.sum() / n.sum() if n.sum() else 0.0)
    known = np.ones(len(n), bool)
    known[-1:] = not level  # a level split never asks for unknown levels
    for _ in range(settings.max_iter):
        g, h = n * raw - total, n.astype(float)
        leaves: list[tuple[np.ndarray, int, tuple | None]] = []

        def leaf(mask: np.ndarray, depth: int) -> tuple[np.ndarray, int, tuple | None]:
            deep = settings.max_depth is not None and depth >= settings.max_depth
            found = None if deep else best_split(g * mask, h * mask, n * mask, level, settings.min_samples_leaf, settings.l2_regularization)
            return mask, depth, found

        leaves.append(leaf(np.ones(len(n), bool), 0))
        while len(leaves) < (settings.max_leaf_nodes or 1 << 31):
            best = max((i for i, x in enumerate(leaves) if x[2]), key=lambda i: (leaves[i][2][0], -i), default=None)
            if best is None:
                break
            mask, depth, (_, cut, *_) = leaves.pop(best)
            left = np.arange(len(n)) == cut if level else np.arange(len(n)) <= cut
            leaves += [leaf(mask & left, depth + 1), leaf(mask & ~left, depth + 1)]
        if len(leaves) == 1 and leaves[0][2] is None and abs(g.sum()) <= 1e-12 * max(1.0, np.abs(g).sum()):
            break
        for mask, _, _ in leaves:
            below = (h * mask).sum() + settings.l2_regularization
            if below > 0:
                raw[mask] -= settings.learning_rate * (g * mask).sum() / below
    return raw


def screen_columns(train: DataFrame, test: DataFrame, encoder: Encoder, settings: Settings) -> DataFrame:
    """(column, test_r2, test_mse) of one boosted model per column, all columns in one job over the coded rows.

    A column is a histogram of rows, targets and squared targets; its model and its test error follow from that.
    """
    if settings.loss != "squared":
        raise ValueError("Columns are screened by squared error.")
    names, sizes, is_level = encoder.preparation.numeric + encoder.preparation.categorical, encoder.sizes, encoder.is_level

    def counted(side: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((3, size)) for size in sizes]
            for codes, y, _, _ in _opened(batches, len(sizes)):
                for f, held in enumerate(sums):
                    for row, weights in enumerate((None, y, y * y)):
                        held[row] += np.bincount(codes[:, f], weights, minlength=sizes[f])
            columns = [pa.array([side] * len(sums), pa.int32()), pa.array(range(len(sums)), pa.int32()), pa.array([x.tobytes() for x in sums], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["side", "feature", "sums"])

        return run

    def fit(table: pa.Table) -> pa.Table:
        sides = table.column("side").to_pylist()
        feature = table.column("feature")[0].as_py()
        payloads = sorted(zip(sides, table.column("sums").to_pylist()))
        train_sums, test_sums = (sum((np.frombuffer(p) for s, p in payloads if s == side), np.zeros(3 * sizes[feature])).reshape(3, -1) for side in (0, 1))
        raw = boost_bins(train_sums[0], train_sums[1], bool(is_level[feature]), settings)
        n, total, squares = test_sums
        rows = n.sum()
        mse = float((squares - 2 * raw * total + n * raw**2).sum() / rows) if rows else None
        spread = float(squares.sum() / rows - (total.sum() / rows) ** 2) if rows else 0.0
        return pa.Table.from_pylist([{"column": names[feature], "test_r2": 1 - mse / spread if spread > 0 else None, "test_mse": mse}], SCREENED)

    schema = "side int, feature int, sums binary"
    both = train.mapInArrow(counted(0), schema).unionByName(test.mapInArrow(counted(1), schema))
    return both.groupBy("feature").applyInArrow(fit, "column string, test_r2 double, test_mse double")


SCREENED = pa.schema([("column", pa.string()), ("test_r2", pa.float64()), ("test_mse", pa.float64())])
