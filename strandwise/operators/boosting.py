"""Multi-target boosted regression trees on histograms of gradients and second derivatives.

Features become bin numbers once, by distributed quantiles, and are stored in chunks of rows.
All models of a fit (one per target, and per fold or setting where those are asked for) grow
side by side: a level of all their trees is one pass. Each partition adds up, per model, node,
feature and bin, the gradients and second derivatives of its rows. The sums are shuffled by slices
of the features, and each slice's best split of a node is found where its sums meet; the driver
gets one row per node and slice, and keeps the best. Missing numbers have a bin of their own, and
each split learns their side.

Gradients are rounded to a fixed step before they are added, so that sums are exact and the
trees don't depend on partitions or on the order of sums.

For a node with sums G and H the best weight minimises G w + (H + reg_lambda) w^2 / 2 +
reg_alpha |w|, within max_delta_step if that is not 0. A split's gain is what it lowers twice
that minimum by; it must exceed 0 and reach ``min_gain``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, fields, replace
from functools import reduce
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.stats import cleaned
from strandwise.operators import evaluation
from strandwise.operators.split import fold_of
from strandwise.session import ensure_checkpoint_dir, settle

FEATURES = "features"
PREFIX = "predicted_"
IMPORTANCE_SCHEMA = "feature string, feature_pos int, target string, importance double"
CURVE_SCHEMA = "target string, round int, validation_mse double"
TREES_SCHEMA = (
    "target_pos int, tree int, node int, feature int, threshold double, missing_right boolean, "
    "value double, gain double"
)

# Configuration name -> parameter here.
CONFIG_NAMES = {
    "n_estimators": "trees",
    "learning_rate": "rate",
    "max_depth": "depth",
    "subsample": "row_share",
    "colsample_bytree": "feature_share",
    "min_child_weight": "min_rows",
    "gamma": "min_gain",
    "random_state": "seed",
    "reg_alpha": "reg_alpha",
    "reg_lambda": "reg_lambda",
    "max_delta_step": "max_delta_step",
    "scale_pos_weight": "scale_pos_weight",
    "early_stopping_rounds": "patience",
}
# These say how another engine runs, not what it computes.
IGNORED = ("n_jobs", "verbosity")

#: Rows of a chunk.
_CHUNK = 1024
#: Sums of gradients stay below this many steps.
_EXACT = 2.0**52
#: Rounds after which the scores of rows are written down and their history is cut.
_CUT = 20
#: Slices of the features, at least: the tasks that find splits. One in four tasks of rows, if more.
_SLICES = 4
#: Bytes of sums of one pass.
_SUM_BYTES = 64 << 20


@dataclass(frozen=True)
class Boosting:
    trees: int = 100
    rate: float = 0.1
    depth: int = 6
    row_share: float = 1.0
    feature_share: float = 1.0
    # Least sum of second derivatives in a leaf: with squared error, of row weights.
    min_rows: float = 1
    min_gain: float = 0.0
    seed: int = 42
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    # Largest absolute weight of a leaf before the rate; 0 for any.
    max_delta_step: float = 0.0
    # Weight of rows whose target is exactly 1.
    scale_pos_weight: float = 1.0
    bins: int = 32
    # Early stopping: name of a boolean column that marks validation rows, which are not fitted.
    validation: str | None = None
    # A round counts as better if it lowers the loss by more than this share of it.
    validation_tolerance: float = 0.01
    # Rounds without a better one before a model stops and goes back to its best round.
    patience: int = 1

    @staticmethod
    def from_config(config: dict) -> Boosting:
        unknown = set(config) - set(CONFIG_NAMES) - set(IGNORED)
        if unknown:
            raise ValueError(f"unknown boosting parameters: {sorted(unknown)}")
        given = {CONFIG_NAMES[k]: v for k, v in config.items() if k in CONFIG_NAMES}
        if "patience" in given:
            given["validation_tolerance"] = 0.0
        return Boosting(**given)

    def with_params(self, **changes) -> Boosting:
        return Boosting(**{**{f.name: getattr(self, f.name) for f in fields(self)}, **changes})


# --- trees ---


class Tree:
    """A tree of at most ``depth`` levels; node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.feature = np.full(size, -1, np.int32)
        self.bin = np.zeros(size, np.int32)
        self.missing_right = np.zeros(size, bool)
        self.value = np.zeros(size)
        self.weight = np.zeros(size)
        self.gain = np.zeros(size)


def node_of(tree, bins: np.ndarray, missing: int, levels: int) -> np.ndarray:
    """The node of each row after so many levels."""
    node = np.zeros(len(bins), np.int64)
    for _ in range(levels):
        at = np.flatnonzero(tree.feature[node] >= 0)
        if not len(at):
            break
        here = node[at]
        code = bins[at, tree.feature[here]]
        node[at] = 2 * here + 1 + np.where(code == missing, tree.missing_right[here], code > tree.bin[here])
    return node


@dataclass
class Model:
    """One boosted model: trees over binned features, and what it learned on the way."""

    target: int
    params: Boosting
    fold: int = -1
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    # Validation loss before the first tree and after each.
    losses: list[float] = field(default_factory=list)
    stopped: bool = False

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    def best_round(self) -> int:
        """The last round that counted as better than all before it."""
        best, at = math.inf, 0
        for i, loss in enumerate(self.losses):
            if i == 0 or best - loss > self.params.validation_tolerance * max(loss, 0.01):
                best, at = min(best, loss), i
        return at


# --- splits from sums ---


def _shrunk(g, params):
    return np.sign(g) * np.maximum(np.abs(g) - params.reg_alpha, 0.0) if params.reg_alpha else g


def leaf_weight(g, h, params):
    """The weight that minimises a node's penalised loss."""
    whole = h + params.reg_lambda
    w = np.divide(-_shrunk(g, params), whole, out=np.zeros_like(whole, float), where=whole > 0)
    step = params.max_delta_step
    return np.clip(w, -step, step) if step > 0 else w


def node_score(g, h, params):
    """Minus twice the least penalised loss of a node."""
    whole = h + params.reg_lambda
    if params.max_delta_step <= 0:
        own = _shrunk(g, params)
        return np.divide(own * own, whole, out=np.zeros_like(whole, float), where=whole > 0)
    w = leaf_weight(g, h, params)
    return -(2 * g * w + whole * w * w + 2 * params.reg_alpha * np.abs(w))


def best_splits(sums: np.ndarray, params) -> np.ndarray:
    """Per node (gain, feature, bin, missing right, g and h of node and left side).

    ``sums`` is nodes x features x bins x 2, the last bin that of missing numbers. Of equal
    gains ``missing left``, the first feature and the first bin win; gain 0 stands for no split.
    """
    own = np.arange(len(sums))
    g, h = (np.cumsum(sums[:, :, :-1, c], axis=2) for c in (0, 1))
    missing_g, missing_h = sums[:, :, -1:, 0], sums[:, :, -1:, 1]
    node_g, node_h = ((x[:, 0, -1] + y[:, 0, 0])[:, None, None] for x, y in ((g, missing_g), (h, missing_h)))
    floor, least = node_score(node_g, node_h, params), max(params.min_rows, 1e-12)
    best = np.zeros((len(sums), 8))
    best[:, 4], best[:, 5] = node_g[:, 0, 0], node_h[:, 0, 0]
    # Without missing numbers both sides are the same.
    for side in (0, 1) if missing_h.any() else (0,):
        left_g, left_h = (g, h) if side else (g + missing_g, h + missing_h)
        right_g, right_h = node_g - left_g, node_h - left_h
        gain = node_score(left_g, left_h, params) + node_score(right_g, right_h, params) - floor
        gain[(left_h < least) | (right_h < least) | (gain <= 1e-12) | (gain < params.min_gain)] = 0.0
        flat = gain.reshape(len(sums), -1)
        at = flat.argmax(axis=1)
        f, b = np.unravel_index(at, gain.shape[1:])
        found = np.column_stack([flat[own, at], f, b, np.full(len(own), side), best[:, 4:6], left_g[own, f, b], left_h[own, f, b]])
        better = found[:, 0] > best[:, 0]
        best[better] = found[better]
    return best


# --- binned rows ---


def cut_points(features: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Per feature the ascending values a split can be at: all values if there are few, else
    values at equal ranks, from one mergeable summary per feature."""
    asked = [i / (bins - 1) for i in range(bins)]
    values = features.select(F.posexplode(FEATURES).alias("pos", "x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    found = values.groupBy("pos").agg(F.percentile_approx("x", asked, 10_000).alias("cuts")).collect()
    cuts = [np.zeros(0)] * width
    for r in found:
        cuts[r["pos"]] = np.unique(r["cuts"])
    return cuts


class Binned:
    """Rows as stored chunks of bin numbers, targets, folds, marks and row numbers."""

    def __init__(self, rows: DataFrame, targets: Sequence[str], width: int, bins: int, fold: Column | None = None, held: Column | None = None):
        if not 2 <= bins <= 255:
            raise ValueError("bins must be 2 to 255")
        self.targets, self.width, self.missing = list(targets), width, bins
        plain = rows.select(
            _array(rows).alias(FEATURES),
            F.array(*[F.coalesce(cleaned(rows, t).cast("double"), F.lit(float("nan"))) for t in targets]).alias("y"),
            (F.lit(-1) if fold is None else fold).cast("int").alias("fold"),
            F.coalesce(F.lit(False) if held is None else held, F.lit(False)).alias("held"),
        )
        numbered = settle(plain.withColumn("row", F.monotonically_increasing_id()))
        self.cuts = cut_points(numbered, width, bins)
        cuts, missing, names = self.cuts, self.missing, len(targets)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, _CHUNK) for b in batches for at in range(0, b.num_rows, _CHUNK)):
                x = np.asarray(batch.column(FEATURES).flatten(), np.float64).reshape(batch.num_rows, width)
                out = np.empty(x.shape, np.uint8)
                for j in range(width):
                    code = np.minimum(np.searchsorted(cuts[j], x[:, j]), max(len(cuts[j]) - 1, 0))
                    out[:, j] = np.where(np.isnan(x[:, j]), missing, code)
                y = np.asarray(batch.column("y").flatten(), np.float64).reshape(batch.num_rows, names)
                parts = (out, y, np.asarray(batch.column("fold")), np.asarray(batch.column("held")), np.asarray(batch.column("row")))
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), *(pa.array([p.tobytes()]) for p in parts)], ["n", "bins", "y", "fold", "held", "row"])

        self.chunks = settle(numbered.mapInArrow(pack, "n long, bins binary, y binary, fold binary, held binary, row binary"))

    def rdd(self) -> RDD:
        """Chunks as arrays, dealt evenly to about as many parts as tasks run at once."""
        width, names = self.width, len(self.targets)

        def opened(r):
            n = r["n"]
            read = lambda c, kind, *shape: np.frombuffer(r[c], kind).reshape(n, *shape)
            return read("bins", np.uint8, width), read("y", np.float64, names), read("fold", np.int32), read("held", bool), read("row", np.int64)

        return self.chunks.repartition(self.chunks.sparkSession.sparkContext.defaultParallelism).rdd.map(opened)


def _array(rows: DataFrame) -> Column:
    column = F.col(FEATURES)
    return vector_to_array(column) if rows.schema[FEATURES].dataType.typeName() == "vectorudt" else column.cast("array<double>")


def _chance(row: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) that row number and seed decide."""
    x = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % (1 << 63))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def _step(rows: float, bound: float) -> float:
    """The power of two that a gradient times it is rounded at: sums over all rows stay exact."""
    return 2.0 ** min(math.floor(math.log2(_EXACT) - math.log2(rows) - math.log2(bound)), 1000)


def _weights(y: np.ndarray, params) -> np.ndarray:
    """Row weights in steps that add up exactly."""
    heavy = round(params.scale_pos_weight * 1024) / 1024
    return np.where(y == 1.0, heavy, 1.0)


def _fitted_rows(chunk, model) -> np.ndarray:
    _, y, fold, held, _ = chunk
    return ~np.isnan(y[:, model.target]) & ~held & ((fold != model.fold) | (model.fold < 0))


def _held_rows(chunk, model) -> np.ndarray:
    _, y, fold, held, _ = chunk
    return ~np.isnan(y[:, model.target]) & (held | ((fold == model.fold) & (model.fold >= 0)))


def _slice_of(key: tuple[int, int, int]) -> int:
    """Sums by (slice of the features, model, level) meet by slice."""
    return key[0]


def _bare(thing) -> SimpleNamespace:
    """Attributes without the class, which every task would have to rebuild."""
    return SimpleNamespace(**vars(thing))


# --- fitting ---


class _Fit:
    """The rounds of a set of models over the same binned rows."""

    def __init__(self, binned: Binned, models: list[Model]):
        self.binned, self.models = binned, models
        self.spark = binned.chunks.sparkSession
        ensure_checkpoint_dir(self.spark)
        self.plain = binned.rdd()
        # The rows' scores one round earlier: kept until those of this round are made.
        self.before: RDD | None = None

    def run(self) -> None:
        rows = self._start()
        bases = np.array([m.base for m in self.models])
        state = self.plain.map(lambda chunk: (chunk, np.tile(bases, (len(chunk[4]), 1)))).persist(StorageLevel.MEMORY_AND_DISK)
        bound = [max(r[2] - m.base, m.base - r[1], 1e-300) for r, m in zip(rows, self.models)]
        counts = [max(r[0], 1) for r in rows]
        most = max(m.params.trees for m in self.models)
        try:
            for t in range(most + 1):
                # The pass of the first level also tells the losses so far.
                active = {i: m for i, m in enumerate(self.models) if not m.stopped and t <= m.params.trees}
                measured = [i for i, m in active.items() if m.params.validation or m.fold >= 0]
                trees = {i: Tree(m.params.depth) for i, m in active.items() if t < m.params.trees}
                heavy = {i: max(self.models[i].params.scale_pos_weight, 1.0) for i in trees}
                steps = {i: _step(counts[i], bound[i] * heavy[i]) for i in trees}
                self._grow(state, t, measured, trees, steps)
                done = {i: tree for i, tree in trees.items() if not self.models[i].stopped}
                for i, tree in done.items():
                    self.models[i].trees.append(tree)
                    bound[i] += np.abs(tree.value).max()
                if not done:
                    break
                state = self._advance(state, done, t)
        finally:
            for kept in (state, self.before):
                if kept is not None:
                    kept.unpersist()
        for m in self.models:
            if m.losses and m.params.validation:
                m.trees = m.trees[: m.best_round()]

    def _start(self) -> list[tuple]:
        """Rows, least and largest target of each model; sets the base to the mean, in nine
        digits, so that it doesn't depend on the order of sums."""
        models = [SimpleNamespace(target=m.target, fold=m.fold, params=_bare(m.params)) for m in self.models]

        def facts(chunks):
            out = np.array([[0, math.inf, -math.inf, 0.0, 0.0]] * len(models))
            for chunk in chunks:
                for i, m in enumerate(models):
                    y = chunk[1][_fitted_rows(chunk, m), m.target]
                    if len(y):
                        w = _weights(y, m.params)
                        out[i] = out[i][0] + len(y), min(out[i][1], y.min()), max(out[i][2], y.max()), out[i][3] + (w * y).sum(), out[i][4] + w.sum()
            yield out

        def both(a, b):
            return np.column_stack([a[:, 0] + b[:, 0], np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 2], b[:, 2]), a[:, 3:] + b[:, 3:]])

        empty = np.array([[0, math.inf, -math.inf, 0.0, 0.0]] * len(models))
        total = self.plain.mapPartitions(facts).treeAggregate(empty, both, both)
        for m, r in zip(self.models, total):
            m.base = float(f"{r[3] / r[4]:.9g}") if r[4] else 0.0
        return [tuple(r[:3]) if r[0] else (0, 0.0, 0.0) for r in total]

    def _advance(self, state: RDD, trees: dict[int, Tree], t: int) -> RDD:
        """Scores of all rows with the new trees."""
        missing, depth = self.binned.missing, [m.params.depth for m in self.models]
        trees = {i: _bare(tree) for i, tree in trees.items()}

        def add(item):
            chunk, scores = item
            scores = scores.copy()
            for i, tree in trees.items():
                scores[:, i] += tree.value[node_of(tree, chunk[0], missing, depth[i])]
            return chunk, scores

        after = state.map(add).persist(StorageLevel.MEMORY_AND_DISK)
        if (t + 1) % _CUT == 0:
            after.checkpoint()
            after.count()
        if self.before is not None:
            self.before.unpersist()
        self.before = state
        return after

    def _grow(self, state: RDD, t: int, losses: list[int], trees: dict[int, Tree], steps: dict[int, float]) -> None:
        """All levels of one round. Of two siblings only the one with fewer rows is added up; the
        other is what their parent has more, exactly."""
        features = {i: self._features(self.models[i].params, t) for i in trees}
        asked: list[dict[int, np.ndarray]] = []
        sent: list[tuple[set[int], RDD]] = []
        for level in range(max([1, *(self.models[i].params.depth for i in trees)])):
            going = [i for i in trees if level < self.models[i].params.depth and not self.models[i].stopped]
            asked.append({i: own for i in going if len(own := self._smaller(trees[i], level))})
            if not asked[-1] and not (losses and level == 0):
                break
            for group in self._groups(asked[-1], features):
                sums = self._pass(state, t, level, losses if level == 0 else [], {i: asked[-1][i] for i in group}, trees, features, steps)
                losses = []
                sent.append((set(group), sums))
                own = [sums for known, sums in sent if not known or not known.isdisjoint(group)]
                found = self._best(own, {i: [nodes[i] for nodes in asked] for i in group})
                for i, pair in sorted(found.pop("losses", {}).items()):
                    self._judge(self.models[i], float(pair[0] / pair[1]), t)
                for i, (nodes, splits) in found.items():
                    if not self.models[i].stopped:
                        self._split(self.models[i], trees[i], features[i], nodes, splits)

    def _groups(self, asked: dict[int, np.ndarray], features: dict[int, np.ndarray]) -> list[list[int]]:
        """Models in groups whose sums a partition can hold at once."""
        groups, room = [[]], 0
        for i, nodes in asked.items():
            size = len(nodes) * len(features[i]) * (self.binned.missing + 1) * 16
            if groups[-1] and room + size > _SUM_BYTES:
                groups.append([])
                room = 0
            groups[-1].append(i)
            room += size
        return groups

    def _features(self, params: Boosting, t: int) -> np.ndarray:
        """The features a tree may use."""
        width = self.binned.width
        if params.feature_share >= 1:
            return np.arange(width)
        some = max(1, math.ceil(params.feature_share * width))
        return np.sort(np.random.default_rng([params.seed & 0xFFFFFFFF, t]).choice(width, some, replace=False))

    @staticmethod
    def _smaller(tree: Tree, level: int) -> np.ndarray:
        """The root, or of each pair of siblings of a level the one of less weight."""
        if level == 0:
            return np.zeros(1, np.int64)
        above = np.arange(2 ** (level - 1) - 1, 2**level - 1)
        left = 2 * above[tree.feature[above] >= 0] + 1
        return left + (tree.weight[left] > tree.weight[left + 1])

    @staticmethod
    def _siblings(nodes: np.ndarray, sums: np.ndarray, parents: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, sums) with the siblings of ``nodes``."""
        if parents is None:
            return nodes, sums
        others = np.where(nodes % 2 == 1, nodes + 1, nodes - 1)
        above, whole = parents
        rest = whole[np.searchsorted(above, (nodes - 1) // 2)] - sums
        both = np.concatenate([nodes, others])
        order = np.argsort(both)
        return both[order], np.concatenate([sums, rest])[order]

    def _pass(self, state: RDD, t: int, level: int, measured: list[int], nodes: dict, trees: dict, features: dict, steps: dict) -> RDD:
        """Sums by slice of the features, model and level, one per partition of the rows, and
        losses: one pass over all rows."""
        models, missing = [SimpleNamespace(target=m.target, fold=m.fold, params=_bare(m.params)) for m in self.models], self.binned.missing
        grown = {i: _bare(trees[i]) for i in nodes}

        def add(total, item):
            chunk, scores = item
            bins, y, _, _, row = chunk
            for i in measured:
                at = np.flatnonzero(_held_rows(chunk, models[i]))
                if len(at):
                    e = scores[at, i] - y[at, models[i].target]
                    losses = total.setdefault("losses", {})
                    losses[i] = losses.get(i, 0.0) + np.array([(e * e).sum(), len(at)])
            for i, own in nodes.items():
                m, used = models[i], features[i]
                fit = _fitted_rows(chunk, m)
                if m.params.row_share < 1:
                    fit &= _chance(row, m.params.seed * 1_000_003 + t) < m.params.row_share
                slot = np.full(2 ** (level + 1) - 1, -1)
                slot[own] = np.arange(len(own))
                place = slot[node_of(grown[i], bins, missing, level)]
                at = np.flatnonzero(fit & (place >= 0))
                target = y[at, m.target]
                weight = _weights(target, m.params)
                step = steps[i]
                g = np.rint(weight * (scores[at, i] - target) * step) / step
                shape = (len(own), len(used), missing + 1)
                if i not in total:
                    total[i] = np.zeros((*shape, 2))
                codes = bins[at] if len(used) == bins.shape[1] else bins[np.ix_(at, used)]
                index = ((place[at, None] * shape[1] + np.arange(shape[1])) * shape[2] + codes).ravel()
                n = math.prod(shape)
                total[i][..., 0] += np.bincount(index, np.repeat(g, shape[1]), n).reshape(shape)
                total[i][..., 1] += np.bincount(index, np.repeat(weight, shape[1]), n).reshape(shape)
            return total

        slices = min(max(state.getNumPartitions() // 4, _SLICES), self.binned.width)

        def sums(part, items):
            total = {}
            for item in items:
                total = add(total, item)
            # Losses are not rounded: the driver adds them in the order of partitions.
            if "losses" in total:
                yield (0, -1 - part, level), (0, total.pop("losses"))
            for i, own in total.items():
                ends = np.arange(slices + 1) * own.shape[1] // slices
                for k, (low, high) in enumerate(zip(ends, ends[1:])):
                    if high > low:
                        yield (k, i, level), (int(low), own[:, low:high])

        return state.mapPartitionsWithIndex(sums).partitionBy(slices, _slice_of)

    def _best(self, sent: list[RDD], asked: dict[int, list[np.ndarray]]) -> dict:
        """Per model (nodes, best splits) of the last level, from the sums of all levels so far,
        and losses. The driver gets one row per node and slice of the features."""
        level = max((len(own) for own in asked.values()), default=1) - 1
        params = {i: _bare(self.models[i].params) for i in asked}
        siblings = self._siblings

        def plus(a, b):
            return a[0], a[1] + b[1]

        def best(items):
            known = {}
            for (k, i, at), own in items:
                if i < 0:
                    if at == level:
                        yield i, own[1]
                else:
                    known.setdefault((k, i), {})[at] = own
            for (_, i), levels in sorted(known.items()):
                both = None
                for at, nodes in enumerate(asked[i]):
                    both = siblings(nodes, levels[at][1], both)
                splits = best_splits(both[1], params[i])
                splits[:, 1] += levels[0][0]
                yield i, (both[0], splits)

        # All have the same partitions, so putting them together and adding up moves nothing more.
        wanted = reduce(RDD.union, sent).filter(lambda item: item[0][1] < 0 or item[0][1] in asked)
        rows = wanted.reduceByKey(plus, sent[0].getNumPartitions(), _slice_of).mapPartitions(best).collect()
        found: dict = {}
        for i, own in sorted((r for r in rows if r[0] < 0), key=lambda r: -r[0]):
            losses = found.setdefault("losses", {})
            for m, pair in own.items():
                losses[m] = losses.get(m, 0.0) + pair
        for i, (nodes, splits) in (r for r in rows if r[0] >= 0):
            if i in found:
                splits = self._better(found[i][1], splits)
            found[i] = nodes, splits
        return found

    @staticmethod
    def _better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of two slices' best splits those of more gain; of equal gains missing left, then the first
        feature."""
        first = (b[:, 3] < a[:, 3]) | ((b[:, 3] == a[:, 3]) & (b[:, 1] < a[:, 1]))
        wins = (b[:, 0] > a[:, 0]) | ((b[:, 0] == a[:, 0]) & (b[:, 0] > 0) & first)
        return np.where(wins[:, None], b, a)

    @staticmethod
    def _split(m: Model, tree: Tree, features: np.ndarray, nodes: np.ndarray, splits: np.ndarray) -> None:
        """Puts the best split of each node, and the weights of its children, into the tree."""
        for node, (gain, f, b, side, g, h, left_g, left_h) in zip(nodes, splits):
            tree.value[node] = m.params.rate * leaf_weight(g, h, m.params)
            if gain <= 0:
                continue
            tree.feature[node], tree.bin[node], tree.missing_right[node], tree.gain[node] = features[int(f)], int(b), bool(side), gain
            for child, own_g, own_h in ((2 * node + 1, left_g, left_h), (2 * node + 2, g - left_g, h - left_h)):
                tree.value[child], tree.weight[child] = m.params.rate * leaf_weight(own_g, own_h, m.params), own_h

    @staticmethod
    def _judge(m: Model, loss: float, t: int) -> None:
        m.losses.append(loss)
        if m.params.validation and t - m.best_round() >= m.params.patience:
            m.stopped = True


# --- the fitted models ---


class MultiTargetModel:
    """Fitted models by target, in target order."""

    def __init__(self, models: dict[str, Model], feature_names: Sequence[str], cuts: list[np.ndarray] | None = None, nodes: list[tuple] | None = None):
        self.models, self.feature_names = models, list(feature_names)
        self.nodes = nodes if nodes is not None else [row for i, m in enumerate(models.values()) for row in _node_rows(i, m, cuts)]

    @property
    def targets(self) -> list[str]:
        return list(self.models)

    def predict(self, features: DataFrame) -> DataFrame:
        """Adds ``predicted_<target>``."""
        packed, names = Packed(self.nodes, [m.base for m in self.models.values()]), self.targets

        @F.arrow_udf("array<double>")
        def predicted(x: pa.Array) -> pa.Array:
            values = np.asarray(x.flatten(), np.float64).reshape(len(x), -1)
            out = packed.scores(values)
            starts = np.arange(len(x) + 1, dtype=np.int32) * out.shape[1]
            return pa.ListArray.from_arrays(starts, pa.array(out.ravel()))

        scored = features.withColumn("_scores", predicted(_array(features)))
        return scored.withColumns({PREFIX + t: F.col("_scores")[i] for i, t in enumerate(names)}).drop("_scores")

    def importance(self, spark: SparkSession) -> DataFrame:
        """Long importance table: each feature's share of all gain, per target. The values are
        >= 0 and add up to 1, or are all 0 if no tree has a split."""
        gain = np.zeros((len(self.models), len(self.feature_names)))
        for target, _, _, feature, _, _, _, own in self.nodes:
            if feature >= 0:
                gain[target, feature] += own
        total = gain.sum(axis=1, keepdims=True)
        share = np.divide(gain, total, out=np.zeros_like(gain), where=total > 0)
        rows = [
            (name, i + 1, target, float(share[t, i]))
            for t, target in enumerate(self.models)
            for i, name in enumerate(self.feature_names)
        ]
        return spark.createDataFrame(rows, IMPORTANCE_SCHEMA)

    def curve(self, spark: SparkSession) -> DataFrame:
        """(target, round, validation_mse): the loss on the marked rows before the first tree
        and after each, up to where a model stopped."""
        rows = [(t, i, loss) for t, m in self.models.items() for i, loss in enumerate(m.losses)]
        return spark.createDataFrame(rows, CURVE_SCHEMA)

    def truncated(self, rounds: int) -> MultiTargetModel:
        """The same models with their first ``rounds`` trees."""
        models = {t: replace(m, trees=m.trees[:rounds]) for t, m in self.models.items()}
        return MultiTargetModel(models, self.feature_names, nodes=[n for n in self.nodes if n[1] < rounds])

    def evaluate(self, features: DataFrame, key: str = "seq_id") -> DataFrame:
        """(target, r2, mse, rmse, mae) against the target columns of ``features``."""
        pairs = evaluation.long_pairs(self.predict(features), self.targets, key)
        return evaluation.basic_metrics(pairs)

    def score(self, features: DataFrame, key: str = "seq_id") -> float:
        return evaluation.score(self.evaluate(features, key))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        bases = [(i, m.base, len(m.trees)) for i, m in enumerate(self.models.values())]
        spark.createDataFrame(self.nodes, TREES_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        spark.createDataFrame(bases, "target_pos int, base double, trees int").coalesce(1).write.mode("overwrite").parquet(f"{path}/bases")

    @staticmethod
    def load(path: str, targets: Sequence[str], feature_names: Sequence[str]) -> MultiTargetModel:
        spark = SparkSession.active()
        nodes = [tuple(r) for r in spark.read.parquet(f"{path}/trees").orderBy("target_pos", "tree", "node").collect()]
        facts = {r["target_pos"]: r for r in spark.read.parquet(f"{path}/bases").collect()}
        models = {t: Model(i, Boosting(), base=facts[i]["base"], trees=[Tree(0)] * facts[i]["trees"]) for i, t in enumerate(targets)}
        return MultiTargetModel(models, feature_names, nodes=nodes)


def _node_rows(target: int, model: Model, cuts: list[np.ndarray]) -> Iterator[tuple]:
    """Rows of the stored form: nodes that a row can reach, thresholds as feature values."""
    for t, tree in enumerate(model.trees):
        reach = [0]
        while reach:
            node = reach.pop()
            f = int(tree.feature[node])
            # A last bin that only sets missing numbers apart has no value above it.
            own = cuts[f] if f >= 0 else ()
            at = float(own[tree.bin[node]]) if f >= 0 and tree.bin[node] < len(own) - 1 else math.inf if f >= 0 else 0.0
            yield target, t, node, f, at, bool(tree.missing_right[node]), float(tree.value[node]), float(tree.gain[node])
            if f >= 0:
                reach += [2 * node + 2, 2 * node + 1]


class Packed:
    """Trees as flat arrays: a step down all trees of a target is one lookup."""

    def __init__(self, nodes: list[tuple], bases: Sequence[float]):
        self.bases = np.array(bases)
        order = sorted(nodes, key=lambda r: r[:3])
        place = {r[:3]: i for i, r in enumerate(order)}
        self.feature = np.array([r[3] for r in order], np.int64)
        self.threshold = np.array([r[4] for r in order])
        self.missing_right = np.array([r[5] for r in order], bool)
        self.value = np.array([r[6] for r in order])
        self.left = np.array([place[r[0], r[1], 2 * r[2] + 1] if r[3] >= 0 else i for i, r in enumerate(order)], np.int64)
        self.right = np.array([place[r[0], r[1], 2 * r[2] + 2] if r[3] >= 0 else i for i, r in enumerate(order)], np.int64)
        self.roots = [np.array([i for i, r in enumerate(order) if r[0] == t and r[2] == 0], np.int64) for t in range(len(bases))]
        self.levels = max((r[2] for r in order), default=0).bit_length()

    def scores(self, values: np.ndarray) -> np.ndarray:
        """rows x targets; trees are added in their order, as in the fit."""
        out = np.tile(self.bases, (len(values), 1))
        every = np.arange(len(values))
        for target, roots in enumerate(self.roots):
            for root in roots:
                node = np.full(len(values), root)
                for _ in range(self.levels):
                    f = self.feature[node]
                    if (f < 0).all():
                        break
                    x = values[every, np.maximum(f, 0)]
                    right = np.where(np.isnan(x), self.missing_right[node], x > self.threshold[node])
                    node = np.where(right, self.right[node], self.left[node])
                out[:, target] += self.value[node]
        return out


def fit_targets(
    features: DataFrame,
    targets: Sequence[str],
    feature_names: Sequence[str],
    params: Boosting = Boosting(),
) -> MultiTargetModel:
    """One model per target, grown side by side; rows without a value for a target are left out
    of its fit."""
    held = F.col(params.validation).cast("boolean") if params.validation else None
    binned = Binned(features, targets, len(feature_names), params.bins, held=held)
    models = [Model(i, params) for i in range(len(targets))]
    _Fit(binned, models).run()
    return MultiTargetModel(dict(zip(targets, models)), feature_names, binned.cuts)


def cross_validate(
    features: DataFrame,
    targets: Sequence[str],
    feature_names: Sequence[str],
    params: Boosting = Boosting(),
    folds: int = 3,
    seed: int = 42,
    key: str = "seq_id",
) -> DataFrame:
    """(fold, score, mean, std): mean R2 over the targets on each held-out fold.

    The models of all folds grow side by side over the same bins; a fold's rows are scored by
    the models that left them out.
    """
    spark = features.sparkSession
    kept = settle(features.withColumn("_fold", fold_of(key, folds, seed)))
    binned = Binned(kept, targets, len(feature_names), params.bins, F.col("_fold"))
    models = [Model(i, params, fold) for fold in range(folds) for i in range(len(targets))]
    _Fit(binned, models).run()
    scores = []
    for fold in range(folds):
        own = {t: m for t, m in zip(targets, models[fold * len(targets) :])}
        model = MultiTargetModel(own, feature_names, binned.cuts)
        scores.append(model.score(kept.where(F.col("_fold") == fold), key))
    known = [s for s in scores if s is not None]
    mean = sum(known) / len(known) if known else None
    std = (sum((s - mean) ** 2 for s in known) / len(known)) ** 0.5 if known else None
    return spark.createDataFrame(
        [(i, s, mean, std) for i, s in enumerate(scores)],
        "fold int, score double, mean double, std double",
    )


def tune(
    features: DataFrame,
    target: str,
    grid: dict[str, Sequence],
    params: Boosting = Boosting(),
    folds: int = 3,
    seed: int = 42,
    key: str = "seq_id",
    keep: float = 1.0,
    first_rounds: int = 10,
) -> tuple[Boosting, DataFrame]:
    """Grid search by mean squared error over the folds: (best parameters, table of all settings).

    ``grid`` uses the configuration names, e.g. ``{"max_depth": [3, 6]}``. Settings that differ
    in ``n_estimators`` only are one model read at several rounds, and all share their bins.
    ``keep`` below 1 races them: after ``first_rounds`` rounds, and each time the rounds have
    doubled, only that share of the models with the least loss goes on; a setting that was left
    behind is listed with the loss and rounds it had then.
    """
    unknown = set(grid) - set(CONFIG_NAMES)
    if unknown:
        raise ValueError(f"unknown boosting parameters: {sorted(unknown)}")
    spark = features.sparkSession
    settings: list[dict] = [{}]
    for name, values in grid.items():
        settings = [{**s, name: v} for s in settings for v in values]
    made = [params.with_params(**{CONFIG_NAMES[k]: v for k, v in s.items()}) for s in settings]
    # One model per setting without its number of trees: the longest serves the shorter ones.
    longest: dict[Boosting, int] = {}
    for p in made:
        short = p.with_params(trees=0)
        longest[short] = max(longest.get(short, 0), p.trees)
    width = len(features.select(_array(features).alias("x")).where("x is not null").first()["x"])
    labelled = features.where(cleaned(features, target).isNotNull())
    binned = Binned(labelled, [target], width, params.bins, fold_of(key, folds, seed))
    losses = _race(binned, longest, folds, keep, first_rounds)
    rows = []
    for s, p in zip(settings, made):
        curve = losses[p.with_params(trees=0)]
        rounds = min(p.trees, len(curve) - 1)
        rows.append(({k: float(v) for k, v in s.items()}, curve[rounds], rounds))
    done = [i for i, p in enumerate(made) if rows[i][2] == p.trees]
    best = made[min(done, key=lambda i: rows[i][1])]
    return best, spark.createDataFrame(rows, "settings map<string,double>, mse double, rounds int")


def _race(binned: Binned, longest: dict[Boosting, int], folds: int, keep: float, first_rounds: int) -> dict[Boosting, list[float]]:
    """Mean validation loss over the folds per round, for each setting."""
    going, out = list(longest), {}
    rounds = first_rounds if keep < 1 else max(longest.values())
    while going:
        models = {p: [Model(0, p.with_params(trees=min(rounds, longest[p])), fold) for fold in range(folds)] for p in going}
        _Fit(binned, [m for own in models.values() for m in own]).run()
        for p, own in models.items():
            known = [m.losses for m in own if m.losses]
            out[p] = np.mean(known, axis=0).tolist() if known else [math.nan]
        going = [p for p in going if rounds < longest[p]]
        going = sorted(going, key=lambda p: out[p][-1])[: max(1, math.ceil(keep * len(going)))] if going else []
        rounds *= 2
    return out
