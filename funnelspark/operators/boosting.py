"""Boosted trees of many trials, fitted together.

The method is that of MLlib's boosted trees: thresholds from 10,000 rows, at most 32 bins a feature, trees on the
gradient of the log loss, grown level by level by the fall in variance. MLlib reads the rows once per level of every
tree of every trial; here a pass over the rows serves the next level of all trials, rows are a byte per feature, and
of two sibling nodes only the smaller is counted, as the other is the parent less it.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

# Executors get the code with each task: MLlib needs no package of ours there either.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What MLlib takes where a trial does not say; other parameters are left to it, and so are deeper trees.
DEFAULTS = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 1.0}
DEEPEST = 8
# As in MLlib: bins of a feature, and rows that thresholds are found on.
BINS, THRESHOLD_ROWS = 32, 10_000
# Rows that are handled at a time, and rows of a task beyond which there are more tasks.
BLOCK_ROWS, TASK_ROWS = 16_384, 1 << 20
# Bins of several features are counted as one code below this; a pair always fits.
CODES = BINS * BINS
# A row keeps a number for each of at most so many trials, and their histograms in a task take at most so many bytes.
TOGETHER, HISTOGRAM_BYTES = 32, 128 << 20
# Histograms of more tasks are added up on the executors first.
DIRECT = 64

BLOCK_SCHEMA = "number bigint, held boolean, bins binary, labels binary"

# Number, bins (feature, row), labels of -1 and 1, sums of the trees so far (trial, row) or None.
Block = tuple[int, np.ndarray, np.ndarray, np.ndarray | None]


def fits_here(df: DataFrame, drawn: list[dict], features: list[str]) -> bool:
    """Whether all trials can be fitted together. Values that MLlib does not allow are left to its errors."""

    def known(p: dict) -> bool:
        own = DEFAULTS | p
        return (
            p.keys() <= DEFAULTS.keys() and own["maxIter"] >= 1 and 0 <= own["maxDepth"] <= DEEPEST
            and 0 < own["stepSize"] <= 1 and 0 < own["subsamplingRate"] <= 1
        )

    plain = all(isinstance(df.schema[c].dataType, T.NumericType | T.BooleanType) for c in features)
    return plain and all(known(p) for p in drawn)


class Tree:
    """Nodes in lists; a node without a split has feature -1, the right child follows the left."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.value = [-1], [0], [0], [0.0]

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float]) -> int:
        """Rows up to the cut go left; the number of the left child."""
        left = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, left
        self.feature += [-1, -1]
        self.cut += [0, 0]
        self.left += [0, 0]
        self.value += values
        return left

    def reached(self, bins: np.ndarray, rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray | None]]:
        """(node without a split, its rows); None stands for all rows."""
        waiting = [(0, rows)]
        while waiting:
            node, rows = waiting.pop()
            f = self.feature[node]
            if f < 0:
                yield node, rows
                continue
            right = (bins[f] if rows is None else bins[f][rows]) > self.cut[node]
            low, high = np.flatnonzero(~right), np.flatnonzero(right)
            if rows is not None:
                low, high = rows[low], rows[high]
            waiting += [(self.left[node], low), (self.left[node] + 1, high)]

    def added(self, sums: np.ndarray, bins: np.ndarray, weight: float) -> None:
        """Add the weighted value of every row's node."""
        for node, rows in self.reached(bins):
            sums[slice(None) if rows is None else rows] += weight * self.value[node]


def best_splits(counts: np.ndarray, sums: np.ndarray) -> list[tuple[int, int, float, float, float, float] | None]:
    """Per node of (node, feature, bin) arrays: feature, cut, rows and sum left and right, or None if nothing is gained.

    The first of equal splits, by feature and cut.
    """
    n, s = np.cumsum(counts, axis=2), np.cumsum(sums, axis=2)
    n_left, s_left = n[:, :, :-1], s[:, :, :-1]
    n_right, s_right = n[:, :, -1:] - n_left, s[:, :, -1:] - s_left
    ok = (n_left > 0) & (n_right > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = np.where(n[:, :, -1:] > 0, s[:, :, -1:] ** 2 / n[:, :, -1:], 0.0)
        gain = np.where(ok, s_left**2 / n_left + s_right**2 / n_right - whole, -np.inf)
    out: list = []
    for i, at in enumerate(gain.reshape(len(gain), -1).argmax(axis=1)):
        f, cut = divmod(int(at), BINS - 1)
        # Differences of sums leave a trace where nothing is gained.
        if gain[i, f, cut] > 1e-10 * whole[i, f, 0]:
            out.append((f, cut, *(float(x[i, f, cut]) for x in (n_left, s_left, n_right, s_right))))
        else:
            out.append(None)
    return out


class Trial:
    """A trial under way: its finished trees, and the one that grows."""

    def __init__(self, place: int, params: dict) -> None:
        own = DEFAULTS | params
        self.place, self.rate, self.step = place, float(own["subsamplingRate"]), float(own["stepSize"])
        self.iterations, self.depth = int(own["maxIter"]), int(own["maxDepth"])
        self.trees: list[tuple[Tree, float]] = []
        self._begin()

    def _begin(self) -> None:
        self.tree, self.level = Tree(), 0
        self.wanted = [0]  # nodes to be counted
        self.pairs: list[tuple[int, int, np.ndarray]] = []  # counted node, its sibling, their parent's histogram

    @property
    def done(self) -> bool:
        return len(self.trees) == self.iterations

    def grow(self, found: np.ndarray) -> bool:
        """Take the histograms (count and sum, node, feature, bin) of the wanted nodes; whether a tree is finished."""
        nodes, hists = list(self.wanted), found
        if self.pairs:
            others = np.stack([parent for _, _, parent in self.pairs], axis=1) - found
            nodes += [other for _, other, _ in self.pairs]
            hists = np.concatenate([found, others], axis=1)
        else:
            n, total = hists[:, 0, 0].sum(axis=1)
            self.tree.value[0] = float(total / n) if n else 0.0
        self.wanted, self.pairs, self.level = [], [], self.level + 1
        for i, best in enumerate(best_splits(hists[0], hists[1]) if self.depth else []):
            if best is None:
                continue
            f, cut, n_left, s_left, n_right, s_right = best
            left = self.tree.split(nodes[i], f, cut, (s_left / n_left, s_right / n_right))
            if self.level < self.depth:
                small, large = (left, left + 1) if n_left <= n_right else (left + 1, left)
                self.wanted.append(small)
                self.pairs.append((small, large, hists[:, i]))
        if self.wanted:
            return False
        self.trees.append((self.tree, self.step if self.trees else 1.0))
        self._begin()
        return True


def thresholds(sample: np.ndarray, rows: int) -> np.ndarray:
    """Where MLlib cuts a feature, from a sample: between all neighbouring values if they are few, else evenly by count."""
    values, counts = np.unique(sample, return_counts=True)
    most = min(BINS, rows) - 1
    between = (values[:-1] + values[1:]) / 2
    if len(between) <= most:
        return between
    stride = len(sample) / (most + 1)
    upto, target, out = np.cumsum(counts), stride, []
    for i, cut in enumerate(between):
        if abs(upto[i] - target) < abs(upto[i + 1] - target):
            out.append(cut)
            target += stride
    return np.array(out)


def _groups(sizes: list[int]) -> list[list[int]]:
    """Features whose bins together make at most ``CODES`` codes; each takes the fullest group it fits into."""
    groups: list[tuple[int, list[int]]] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        fitting = [g for g in range(len(groups)) if groups[g][0] * sizes[f] <= CODES]
        if fitting:
            g = max(fitting, key=lambda g: groups[g][0])
            groups[g] = (groups[g][0] * sizes[f], [*groups[g][1], f])
        else:
            groups.append((sizes[f], [f]))
    return [members for _, members in groups]


def _binner(cuts: list[np.ndarray]):
    """Arrow batches of features, label and "held" to rows of ``BLOCK_SCHEMA``."""

    def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bool, list] = {False: [], True: []}
        number = TaskContext.get().partitionId() << 32

        def block(held: bool) -> pa.RecordBatch:
            nonlocal number
            bins = np.concatenate([b for b, _ in kept[held]], axis=1)
            labels = np.concatenate([y for _, y in kept[held]])
            kept[held] = []
            number += 1
            row = {"number": number, "held": held, "bins": bins.tobytes(), "labels": labels.tobytes()}
            types = [pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], list(row))

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(cuts) + 2)]
            bins = np.stack([np.searchsorted(c, x).astype(np.uint8) for c, x in zip(cuts, columns)])
            labels = np.where(columns[-2] == 1, 1, -1).astype(np.int8)
            for held in (False, True):
                rows = columns[-1] == held
                if rows.any():
                    kept[held].append((bins[:, rows], labels[rows]))
                if sum(len(y) for _, y in kept[held]) >= BLOCK_ROWS:
                    yield block(held)
        for held in (False, True):
            if kept[held]:
                yield block(held)

    return binned


def _read(row) -> Block:
    labels = np.frombuffer(row["labels"], np.int8)
    return row["number"], np.frombuffer(row["bins"], np.uint8).reshape(-1, len(labels)), labels, None


def _advanced(finished: list[tuple[int, Tree, float]], places: int):
    """Blocks with the values of finished trees (trial, tree, weight) added."""

    def advance(block: Block) -> Block:
        number, bins, labels, sums = block
        sums = np.zeros((places, len(labels))) if sums is None else sums.copy()
        for place, tree, weight in finished:
            tree.added(sums[place], bins, weight)
        return number, bins, labels, sums

    return advance


def _counted(plans: list[tuple[int, int, float, Tree, list[int]]], sizes: list[int], seed: int):
    """Blocks to one dictionary of histograms (count and sum, node, feature, bin) by trial.

    A plan is trial, number of its tree, share of rows it learns from, the tree so far and the nodes to count.
    """
    groups = _groups(sizes)
    widths = [math.prod(sizes[f] for f in g) for g in groups]

    def count(blocks: Iterable[Block]) -> Iterator[dict[int, np.ndarray]]:
        joint = {plan[0]: [np.zeros((2, len(plan[4]) * w)) for w in widths] for plan in plans}
        for number, bins, labels, sums in blocks:
            codes = []
            for g in groups:
                code = bins[g[0]].astype(np.intp)
                for f in g[1:]:
                    code = code * sizes[f] + bins[f]
                codes.append(code)
            draws: dict[int, np.ndarray] = {}
            for place, trees, rate, tree, wanted in plans:
                rows = None
                if rate < 1:
                    if trees not in draws:
                        rng = np.random.Generator(np.random.SFC64([seed, trees, number]))
                        draws[trees] = rng.random(len(labels), dtype=np.float32)
                    rows = np.flatnonzero(draws[trees] < rate)
                if len(tree.feature) > 1:
                    found = dict(tree.reached(bins, rows))
                    parts = [found[node] for node in wanted]
                    rows = np.concatenate(parts)
                    node_of = np.repeat(np.arange(len(wanted)), [len(p) for p in parts])
                else:
                    node_of = None
                take = slice(None) if rows is None else rows
                target = labels[take].astype(float)
                if trees and sums is not None:
                    target = 4 * target / (1 + np.exp(2 * target * sums[place][take]))
                for code, width, into in zip(codes, widths, joint[place]):
                    at = code[take]
                    if node_of is not None:
                        at = at + node_of * width
                    into[0] += np.bincount(at, minlength=into.shape[1])
                    into[1] += np.bincount(at, target, into.shape[1])
        out = {}
        for place, _, _, _, wanted in plans:
            out[place] = np.zeros((2, len(wanted), len(sizes), BINS))
            for g, whole in zip(groups, joint[place]):
                shaped = whole.reshape(2, len(wanted), *[sizes[f] for f in g])
                for i, f in enumerate(g):
                    rest = tuple(2 + j for j in range(len(g)) if j != i)
                    out[place][:, :, f, : sizes[f]] = shaped.sum(axis=rest)
        yield out

    return count


def _added(one: dict[int, np.ndarray], other: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    for place, hist in other.items():
        one[place] = one[place] + hist if place in one else hist
    return one


def _total(found: RDD) -> dict[int, np.ndarray]:
    if found.getNumPartitions() > DIRECT:
        return found.treeReduce(_added)
    out: dict[int, np.ndarray] = {}
    for part in found.collect():
        _added(out, part)
    return out


def _grown(blocks: RDD, trials: list[Trial], sizes: list[int], seed: int) -> None:
    """Grow all trees of all trials. Values of finished trees are kept with the rows once half the trials have any."""
    state, waiting = blocks, []
    while running := [t for t in trials if not t.done]:
        now = state.map(_advanced(waiting, len(trials))) if waiting else state
        kept = 2 * len(waiting) >= len(running)
        if kept:
            now = now.persist(StorageLevel.MEMORY_AND_DISK)
        plans = [(t.place, len(t.trees), t.rate, t.tree, t.wanted) for t in running]
        found = _total(now.mapPartitions(_counted(plans, sizes, seed)))
        if kept:
            if state is not blocks:
                state.unpersist()
            state, waiting = now, []
        for t in running:
            if t.grow(found[t.place]):
                waiting.append((t.place, *t.trees[-1]))
    if state is not blocks:
        state.unpersist()


def _judged(trials: list[Trial]):
    """Blocks to one dictionary of rows by label and prediction, by trial."""
    forests = [(t.place, t.trees) for t in trials]

    def judge(blocks: Iterable[Block]) -> Iterator[dict[int, np.ndarray]]:
        out = {place: np.zeros(4, np.int64) for place, _ in forests}
        for _, bins, labels, _ in blocks:
            for place, trees in forests:
                sums = np.zeros(len(labels))
                for tree, weight in trees:
                    tree.added(sums, bins, weight)
                out[place] += np.bincount(2 * (labels > 0) + (sums > 0), minlength=4)
        yield out

    return judge


def fitted_together(
    df: DataFrame, held: str, drawn: list[dict], features: list[str], label: str, seed: int = 42
) -> list[list[tuple[float, float, float]]]:
    """Per trial, (label, prediction, rows) on the rows where ``held`` is true, by trees learned on the others.

    Features hold no null or NaN and labels are 0 or 1. A trial's rows are drawn anew for each tree.
    """
    spark = df.sparkSession
    rows = df.select(
        *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)],
        F.col(label).cast("double").alias("label"), F.col(held).alias("held"),
    )
    train = rows.filter(~F.col("held"))
    n, total = rows.agg(F.count_if(~F.col("held")), F.count("*")).first()
    if not n:
        raise ValueError("there are no rows to learn from")
    share = THRESHOLD_ROWS / n
    sample = (train.sample(share, seed) if share < 1 else train).drop("label", "held").toArrow()
    cuts = [thresholds(sample.column(i).to_numpy(), n) for i in range(len(features))]
    sizes = [len(c) + 1 for c in cuts]
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(total / TASK_ROWS))
    stored = stage(rows.mapInArrow(_binner(cuts), BLOCK_SCHEMA).repartition(tasks), "binned")

    def of(side: bool) -> RDD:
        chosen = stored.filter(F.col("held") == side).rdd.map(_read)
        # Few blocks are read as one file; the tasks are to stay as many.
        return chosen.repartition(tasks) if chosen.getNumPartitions() < tasks else chosen

    blocks = of(False).persist(StorageLevel.MEMORY_AND_DISK)
    widths = sum(math.prod(sizes[f] for f in g) for g in _groups(sizes))
    # Of the deepest level that is counted, half the nodes are.
    nodes = 1 << max(0, max((DEFAULTS | p)["maxDepth"] for p in drawn) - 2)
    many = max(1, min(TOGETHER, HISTOGRAM_BYTES // (16 * widths * nodes)))
    out: list[list[tuple[float, float, float]]] = []
    try:
        for first in range(0, len(drawn), many):
            trials = [Trial(i, p) for i, p in enumerate(drawn[first : first + many])]
            _grown(blocks, trials, sizes, seed)
            found = _total(of(True).mapPartitions(_judged(trials)))
            out += [
                [(float(at // 2), float(at % 2), float(n)) for at, n in enumerate(found[t.place]) if n] for t in trials
            ]
    finally:
        blocks.unpersist()
    return out
