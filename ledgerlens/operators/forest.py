"""Random forest (L2): all trees grow level by level from one aggregate of sparse counts, over every row.

Rows are cut into cells (feature, bin) once, as in ``boosting``, and stay sparse, so a row takes what it has features,
not the width of the vocabulary.  A level of all trees is one job:

 * every node draws its own features (``featureSubsetStrategy``) and every tree its own weight for each row (Poisson of
   ``subsamplingRate``, by a hash of the row);
 * every task counts class weights per (node, drawn feature, bin), zeros' bins left out, since they follow as the node's
   total less the other bins, and sends them merged, by node;
 * the reducers add up a node's counts and answer with its best split (Gini); the driver sees one row per open node,
   never rows of data, and sends the splits back with the next job.

Counts are whole numbers and ties go to the first feature and bin, so the model does not depend on partitions or task
order.  The model is a node table (tree, node, feature, threshold, class weights), bounded by its parameters.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .boosting import TASK_ROWS, Layout, _cells_column, _margin_column, _pieces, entries, fit_layout, uniform

HOLD = 4 << 20                  # counts a task holds before it merges them
SEND = 4 << 20                  # bytes of counts a task sends at once
CELLS = 4 << 20                 # (feature, bin, class) sums looked at at once
MOST_WEIGHT = 32                # a Poisson weight beyond this has no share worth a step


@dataclass(frozen=True)
class ForestParams:
    """Named and defined as Spark ML names and defines them."""

    numTrees: int = 40
    maxDepth: int = 10
    maxBins: int = 32
    subsamplingRate: float = 0.7
    featureSubsetStrategy: str = "sqrt"
    minInstancesPerNode: int = 1
    minInfoGain: float = 0.0
    seed: int = 42

    def __post_init__(self):
        if self.numTrees < 1 or self.maxDepth < 0 or self.maxBins < 2 or not 0 < self.subsamplingRate <= 1:
            raise ValueError("numTrees must be 1 or more, maxDepth 0 or more, maxBins 2 or more, subsamplingRate in (0, 1]")

    def drawn(self, n_features: int) -> int:
        """Features a node may split on."""
        s = self.featureSubsetStrategy
        if s == "auto":
            s = "sqrt" if self.numTrees > 1 else "all"
        share = {"all": n_features, "sqrt": math.sqrt(n_features), "log2": math.log2(max(n_features, 2)), "onethird": n_features / 3}
        n = share[s] if s in share else float(s) if s.isdigit() else float(s) * n_features
        return int(min(max(math.ceil(n), 1), n_features))


# (max_bin, min_rows) are what ``fit_layout`` reads
@dataclass(frozen=True)
class _Bins:
    max_bin: int
    min_rows: int = 1


@dataclass
class Trees:
    """Nodes of all trees as parallel arrays; children of node i are 2 i + 1 (x <= threshold) and 2 i + 2."""

    tree: list = field(default_factory=list)
    node: list = field(default_factory=list)
    feature: list = field(default_factory=list)               # -1: leaf
    threshold: list = field(default_factory=list)
    stats: list = field(default_factory=list)                 # weight of each class

    def add(self, tree, node, feature, threshold, stats):
        for name, v in zip(TREE_FIELDS, (tree, node, feature, threshold, stats)):
            getattr(self, name).append(v)


TREE_FIELDS = ("tree", "node", "feature", "threshold", "stats")
TREE_SCHEMA = "tree int, node int, feature int, threshold double, stats array<double>"
_ROW = "label int, key long, cells array<int>"
_PART = "j int, keys binary, weights binary"
_BEST = "j int, slot int, bin int, gain double, total binary, left_stats binary"


def bag(p: ForestParams, keys: np.ndarray, tree: int) -> np.ndarray:
    """How often each row counts in a tree: Poisson of the rate; a single tree takes that share of the rows once."""
    if p.numTrees == 1:
        return (uniform(keys, p.seed, tree) < p.subsamplingRate).astype(np.int64)
    share, steps = math.exp(-p.subsamplingRate), []
    for k in range(MOST_WEIGHT):
        steps.append((steps[-1] if steps else 0.0) + share)
        share *= p.subsamplingRate / (k + 1)
    return np.searchsorted(np.array(steps), uniform(keys, p.seed, tree), "right")


def draw_features(p: ForestParams, n_features: int, n_drawn: int, tree: int, node: int) -> np.ndarray:
    return np.sort(np.random.default_rng((p.seed, tree, node)).choice(n_features, n_drawn, replace=False))


class Router:
    """Trees laid out for whole batches: per tree arrays by node of feature slot, bin and number of the leaf."""

    def __init__(self, layout: Layout, trees: Trees):
        feature = np.array(trees.feature, np.int64)
        inner = feature >= 0
        kept = np.searchsorted(layout.features, feature[inner])
        bins = np.searchsorted(layout._flat, kept + 1j * np.array(trees.threshold, float)[inner], "left") - layout._first[kept]
        slot, cut = np.full(len(feature), -1, np.int32), np.zeros(len(feature), np.int16)
        slot[inner], cut[inner] = kept, bins
        tree, node = np.array(trees.tree, np.int64), np.array(trees.node, np.int64)
        self.trees = []
        for t in range(int(tree.max()) + 1 if len(tree) else 0):
            at = np.flatnonzero(tree == t)
            width = int(node[at].max()) + 1
            f, b, row = np.full(width, -1, np.int32), np.zeros(width, np.int16), np.zeros(width, np.int64)
            f[node[at]], b[node[at]], row[node[at]] = slot[at], cut[at], at
            self.trees.append((f, b, row))

    def reached(self, bins: np.ndarray, t: int, rows: np.ndarray | None = None) -> np.ndarray:
        """Node each row (of ``rows``) ends in, in tree ``t``."""
        f, b, _ = self.trees[t]
        rows = np.arange(len(bins)) if rows is None else rows
        at, on = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(on):
            slot = f[at[on]]
            go = slot >= 0
            on, slot = on[go], slot[go]
            at[on] = 2 * at[on] + 1 + (bins[rows[on], slot] > b[at[on]])
        return at


def _matrix(layout: Layout, n: int, row: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """(n, features) bins of all kept features."""
    out = np.tile(layout.zero.astype(np.int16), (n, 1))
    f = layout.of[cell]
    out[row, f] = cell - layout.start[f]
    return out


def _merged(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of equal keys added up, by rising key."""
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(weights[by], first) if len(first) else weights[:0]


@dataclass
class _Level:
    """What a job of one level is told."""

    trees: Trees                    # without class weights
    nodes: list                     # open (tree, node), by tree
    drawn: np.ndarray               # (open nodes, drawn features) slots in the layout, rising; -1 after the last
    n_classes: int
    n_bins: int

    def key(self, j, c, b, label):
        return ((j * (self.drawn.shape[1] + 1) + c) * self.n_bins + b) * self.n_classes + label

    def parts(self, keys):
        """(node, drawn feature or their number for the node's total, bin, class) of keys."""
        rest, label = np.divmod(keys, self.n_classes)
        rest, b = np.divmod(rest, self.n_bins)
        j, c = np.divmod(rest, self.drawn.shape[1] + 1)
        return j, c, b, label


def _binner(shared):
    def run(it):
        for b in it:
            row, cell = shared.value.codes(*entries(b["features"]))
            yield pa.RecordBatch.from_arrays([b["label"], b["key"], _cells_column(b.num_rows, row, cell)], names=["label", "key", "cells"])
    return run


def _batch(rows: list, names: tuple, types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))


def _counts(shared, p: ForestParams):
    """One level of all trees: class weights per open node, drawn feature and bin other than the zeros'."""
    def run(it):
        layout, level = shared.value
        router = Router(layout, level.trees)
        n_drawn = level.drawn.shape[1]
        slots = {}                                              # tree: number of each open node
        for j, (t, node) in enumerate(level.nodes):
            slots.setdefault(t, []).append((node, j))
        for t, found in slots.items():
            of = np.full(len(router.trees[t][0]), -1)
            of[[n for n, _ in found]] = [j for _, j in found]
            slots[t] = of
        kept_keys, kept_weights, held = [], [], 0
        for b in _pieces(it):
            label, key = (b[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "key"))
            size = b["cells"].value_lengths().to_numpy(zero_copy_only=False)
            cell = b["cells"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            bins = _matrix(layout, b.num_rows, np.repeat(np.arange(b.num_rows), size), cell)
            for t, of in slots.items():
                weight = bag(p, key, t)
                rows = np.flatnonzero(weight)
                j = of[router.reached(bins, t, rows)]
                rows, j = rows[j >= 0], j[j >= 0]
                if not len(rows):
                    continue
                kept_keys.append(level.key(j, n_drawn, 0, label[rows]))
                kept_weights.append(weight[rows])
                held += len(rows)
                if bins.shape[1]:
                    use = level.drawn[j]
                    found = bins[rows[:, None], use]
                    r, c = np.nonzero((found != layout.zero[use]) & (use >= 0))
                    kept_keys.append(level.key(j[r], c, found[r, c], label[rows[r]]))
                    kept_weights.append(weight[rows[r]])
                    held += len(r)
            if held > HOLD:
                keys, weights = _merged(np.concatenate(kept_keys), np.concatenate(kept_weights))
                kept_keys, kept_weights = [keys], [weights]
                # a merge that frees little is not tried again at once
                held = 0 if len(keys) > HOLD // 2 else len(keys)
        if not kept_keys:
            return
        keys, weights = _merged(np.concatenate(kept_keys), np.concatenate(kept_weights))
        part, out, size = level.parts(keys)[0], [], 0
        for a, z in zip(first := np.flatnonzero(np.diff(part, prepend=-1)), [*first[1:], len(keys)]):
            # rising keys as steps: small numbers, which the exchange compresses
            out.append((int(part[a]), np.diff(keys[a:z], prepend=0).tobytes(), weights[a:z].astype(np.int64).tobytes()))
            size += 16 * (z - a)
            if size > SEND:
                yield _batch(out, ("j", "keys", "weights"), (pa.int32(), pa.binary(), pa.binary()))
                out, size = [], 0
        if out:
            yield _batch(out, ("j", "keys", "weights"), (pa.int32(), pa.binary(), pa.binary()))
    return run


def best_split(counts: np.ndarray, p: ForestParams) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of a node's class weights (feature, bin, class): bins up to it go left.
    The gain is that of Gini impurity; ties go to the first feature and bin."""
    left = counts.cumsum(1)[:, :-1]
    total = counts[0].sum(0)
    n, right = total.sum(), total - left
    nl, nr = left.sum(2), right.sum(2)
    fine = (nl >= max(p.minInstancesPerNode, 1)) & (nr >= max(p.minInstancesPerNode, 1))
    if not fine.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        pure = (left * left).sum(2) / nl + (right * right).sum(2) / nr
    gain = np.where(fine, pure / n - (total * total).sum() / (n * n), -1.0)
    c, b = np.unravel_index(int(gain.argmax()), gain.shape)
    best = float(gain[c, b])
    return (best, int(c), int(b)) if best > 1e-12 and best >= p.minInfoGain else None


def _splitter(shared, p: ForestParams):
    """Adds up the counts of a node and finds its best split."""
    types = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary())

    def settle(level, layout, node, keys, weights):
        _, c, b, label = level.parts(keys)
        n_drawn = level.drawn.shape[1]
        whole = c == n_drawn
        classes, total = label[whole], weights[whole]           # the classes of the node, by number
        c, b, label, weights = c[~whole], b[~whole], np.searchsorted(classes, label[~whole]), weights[~whole]
        use = level.drawn[node][level.drawn[node] >= 0]
        best, left = None, np.zeros(level.n_classes, np.int64)
        step = max(1, CELLS // (level.n_bins * len(classes)))
        for lo in range(0, len(use) if len(classes) > 1 else 0, step):
            some = use[lo:lo + step]
            counts = np.zeros((len(some), level.n_bins, len(classes)), np.int64)
            at = slice(*np.searchsorted(c, (lo, lo + step)))
            counts[c[at] - lo, b[at], label[at]] = weights[at]
            counts[np.arange(len(some)), layout.zero[some]] = total - counts.sum(1)
            found = best_split(counts.astype(np.float64), p)
            if found and (best is None or found[0] > best[0]):
                best = found[0], int(some[found[1]]), found[2]
                left[classes] = counts[found[1], :found[2] + 1].sum(0)
        stats = np.zeros(level.n_classes, np.int64)
        stats[classes] = total
        gain, slot, cut = best or (0.0, -1, -1)
        return node, slot, cut, gain, stats.tobytes(), left.tobytes()

    def run(it):
        layout, level = shared.value
        now, keys, weights, held, out = None, [], [], 0, []
        for batch in it:
            for j, k, w in zip(batch["j"].to_pylist(), batch["keys"], batch["weights"]):
                if j != now and keys:
                    out.append(settle(level, layout, now, *_merged(np.concatenate(keys), np.concatenate(weights))))
                    keys, weights, held = [], [], 0
                now = j
                keys.append(np.cumsum(np.frombuffer(k.as_buffer(), np.int64)))
                weights.append(np.frombuffer(w.as_buffer(), np.int64))
                held += len(keys[-1])
                if held > HOLD and len(keys) > 1:
                    merged = _merged(np.concatenate(keys), np.concatenate(weights))
                    keys, weights, held = [merged[0]], [merged[1]], 0
        if keys:
            out.append(settle(level, layout, now, *_merged(np.concatenate(keys), np.concatenate(weights))))
        yield _batch(out, ("j", "slot", "bin", "gain", "total", "left_stats"), types)
    return run


class RandomForest:
    """Estimator over columns ``features`` (ML vectors) and ``label``; the other columns only tell rows apart."""

    def __init__(self, **params):
        self.params = ForestParams(**params)

    def fit(self, x: DataFrame) -> "ForestModel":
        p, spark = self.params, x.sparkSession
        first = x.agg(F.max("label").alias("top"), F.count(F.lit(1)).alias("n")).first()
        if first["top"] is None:
            raise ValueError("no rows to fit on")
        n_classes, n = int(first["top"]) + 1, first["n"]
        n_features = x.select("features").first()[0].size
        layout = fit_layout(x, _Bins(p.maxBins), rows_per_bin=None)
        tasks = max(-(-n // TASK_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // 256)))
        rows = x.select(F.col("label").cast("int").alias("label"), F.xxhash64(*x.columns).alias("key"), "features")
        shared = spark.sparkContext.broadcast(layout)
        rows = written(rows.repartition(tasks, "key").mapInArrow(_binner(shared), _ROW), "forest-rows")
        n_drawn = p.drawn(n_features)
        slot_of = np.full(n_features, -1)
        slot_of[layout.features] = np.arange(len(layout.features))
        trees = Trees()
        open_nodes = [(t, 0) for t in range(p.numTrees)]
        at = {}
        for t, node in open_nodes:
            at[t, node] = len(trees.tree)
            trees.add(t, node, -1, 0.0, np.zeros(n_classes))
        for depth in range(p.maxDepth + 1):
            drawn = np.full((len(open_nodes), n_drawn), -1)
            for j, (t, node) in enumerate(open_nodes):
                # features that are the same in every row cannot split
                found = slot_of[draw_features(p, n_features, n_drawn, t, node)]
                found = found[found >= 0]
                drawn[j, :len(found)] = found
            if depth == p.maxDepth:
                drawn[:] = -1
            drawn = drawn[:, :max(1, int((drawn >= 0).sum(1).max()))]
            known = Trees(*(np.array(getattr(trees, k)) for k in TREE_FIELDS[:4]))
            shared = spark.sparkContext.broadcast(
                (layout, _Level(known, open_nodes, drawn, n_classes, int(layout.bins.max()) if len(layout.bins) else 1)))
            best = (rows.mapInArrow(_counts(shared, p), _PART).repartition("j").sortWithinPartitions("j")
                    .mapInArrow(_splitter(shared, p), _BEST).collect())        # open nodes
            shared.destroy()
            following = []
            for r in sorted(best, key=lambda r: r["j"]):
                t, node = open_nodes[r["j"]]
                i = at[t, node]
                total = np.frombuffer(r["total"], np.int64)
                trees.stats[i] = total.astype(float)
                if r["slot"] < 0:
                    continue
                trees.feature[i] = int(layout.features[r["slot"]])
                trees.threshold[i] = float(layout.edges[r["slot"]][r["bin"]])
                left = np.frombuffer(r["left_stats"], np.int64)
                for child, stats in ((2 * node + 1, left), (2 * node + 2, total - left)):
                    at[t, child] = len(trees.tree)
                    trees.add(t, child, -1, 0.0, stats.astype(float))
                    if depth + 1 < p.maxDepth and (stats > 0).sum() > 1 and stats.sum() >= 2 * p.minInstancesPerNode:
                        following.append((t, child))
            open_nodes = following
            if not open_nodes:
                break
        return ForestModel(spark, n_classes, n_features, trees, p)


class ForestModel:
    """Fitted trees.  A row's probabilities are the mean of its leaves' class shares."""

    def __init__(self, spark: SparkSession, n_classes: int, n_features: int, trees: Trees, params: ForestParams):
        self.spark, self.n_classes, self.n_features, self.trees, self.params = spark, n_classes, n_features, trees, params
        used: dict[int, set] = {}
        for f, t in zip(trees.feature, trees.threshold):
            if f >= 0:
                used.setdefault(f, set()).add(t)
        names = sorted(used)
        self.layout = Layout(np.array(names, np.int64), [np.array(sorted(used[f])) for f in names])

    def shares(self) -> np.ndarray:
        """(nodes, classes) class shares; a tree that no row came to knows nothing and gives every class the same."""
        stats = np.array(self.trees.stats, float).reshape(len(self.trees.tree), self.n_classes)
        cover = stats.sum(1, keepdims=True)
        return np.where(cover > 0, stats / np.maximum(cover, 1e-300), 1.0 / self.n_classes)

    def transform(self, x: DataFrame) -> DataFrame:
        """``x`` with ``probability`` (a vector), per Arrow batch and without a shuffle."""
        shared = x.sparkSession.sparkContext.broadcast(
            (self.layout, Trees(*(np.array(getattr(self.trees, k)) for k in TREE_FIELDS[:4])), self.shares()))
        n_classes, names = self.n_classes, x.columns

        def run(it):
            layout, trees, shares = shared.value
            router = Router(layout, trees)
            for b in _pieces(it):
                row, cell = layout.codes(*entries(b["features"]))
                bins = _matrix(layout, b.num_rows, row, cell)
                total = np.zeros((b.num_rows, n_classes))
                for t, (_, _, at) in enumerate(router.trees):
                    total += shares[at[router.reached(bins, t)]]
                vector = pa.StructArray.from_arrays(
                    [pa.array(np.ones(b.num_rows, np.int8)), pa.nulls(b.num_rows, pa.int32()),
                     pa.nulls(b.num_rows, pa.list_(pa.int32())), _margin_column(total / len(router.trees))],
                    names=["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([*[b[c] for c in names], vector], names=[*names, "probability"])
        return x.mapInArrow(run, T.StructType([*x.schema.fields, T.StructField("probability", VectorUDT(), False)]))

    def node_table(self) -> DataFrame:
        t = self.trees
        rows = [(*r, s.tolist()) for *r, s in zip(t.tree, t.node, t.feature, t.threshold, t.stats)]
        return self.spark.createDataFrame(rows, TREE_SCHEMA)

    def save(self, path: str) -> None:
        self.node_table().write.mode("overwrite").parquet(f"{path}/data")
        meta = {"n_classes": self.n_classes, "n_features": self.n_features, "params": asdict(self.params)}
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ForestModel":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        rows = spark.read.parquet(f"{path}/data").orderBy("tree", "node").collect()
        trees = Trees(*([r[k] for r in rows] for k in TREE_FIELDS[:4]), [np.array(r["stats"], float) for r in rows])
        return cls(spark, meta["n_classes"], meta["n_features"], trees, ForestParams(**meta["params"]))
