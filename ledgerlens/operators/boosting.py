"""Joint softmax boosting (L2): all classes' trees of a round grow from one aggregate.

Each round adds one regression tree per class, fitted to the gradient and hessian of the softmax log loss.  Trees grow
level by level, and a level of all classes is one aggregate keyed (class, node, feature, bin) of gradient and hessian:

 * features are cut at quantiles once (mergeable per-feature summaries); a row then holds the cells (feature, bin) it
   is in, apart from those of its zeros, which follow as the node's total less the other bins;
 * every task sums its rows' gradients per (class, node) and cell, and sends sparse rows keyed (class, node, block of
   cells); the reducers add them up as a stream, one block at a time, and answer with the best split of the block;
 * the driver sees one row per open node and block, never rows of data, and sends the splits back with the next job.

Gradients are rounded to 2**-24 and summed as integers, so the model does not depend on partitions or task order.
Margins are written every ``CHECKPOINT`` rounds to the shared folder; in between the last trees are applied in the task.
Rows in column ``held`` take no part in the trees; when their log loss has not fallen for ``patience`` rounds the
boosting stops, and the rounds after the best one are dropped.  Column ``weight`` scales a row's gradient.

The model is a node table (round, class, node, feature, threshold, value, cover), bounded by its parameters.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written

SCALE = float(1 << 24)          # gradients are whole multiples of 1 / SCALE
CHECKPOINT = 8                  # rounds between two written margins
BLOCK_CELLS = 8192              # cells a reducer adds up at once
ACCUMULATE = 4 << 20            # cells whose sums a task holds at once
HOLD_ROWS = 100_000             # rows a task holds at once
BATCH = 2048                    # rows handled at once
TASK_ROWS = 100_000             # rows of a task, at most on average
ROWS_PER_BIN = 20               # non-zero rows a bin should have


@dataclass(frozen=True)
class BoostingParams:
    n_estimators: int = 60
    max_depth: int = 4
    learning_rate: float = 0.3
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    colsample_bylevel: float = 0.8
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    min_child_weight: float = 0.1
    gamma: float = 0.0
    max_delta_step: float = 0.0
    max_bin: int = 64
    min_rows: int = 8            # a feature that is not zero in fewer rows is not split on
    patience: int | None = 10
    held_share: float = 0.1      # of rows, by hash, if there is no column ``held``
    seed: int = 42

    def __post_init__(self):
        if self.max_depth < 1 or self.max_bin < 2 or self.n_estimators < 1:
            raise ValueError("max_depth and n_estimators must be 1 or more, max_bin 2 or more")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, *salts: int) -> np.ndarray:
    """A number in [0, 1) for each key, the same wherever it is computed."""
    h = _mix(np.asarray(keys).astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for s in salts:
        h = _mix(h + _mix(np.array([s], np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def allowed(p: BoostingParams, n_features: int, turn: int, cls: int, level: int) -> np.ndarray:
    """Features that a level of a class's tree may split on."""
    f = np.arange(n_features)
    ok = (uniform(f, p.seed, turn, cls, 1) < p.colsample_bytree) & (uniform(f, p.seed, turn, cls, 2 + level) < p.colsample_bylevel)
    return ok if ok.any() else np.ones(n_features, bool)


def in_sample(p: BoostingParams, keys: np.ndarray, turn: int) -> np.ndarray:
    return uniform(keys, p.seed, turn, 0) < p.subsample


# ------------------------------------------------------------------ features
def entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of what is not zero in a column of ML vectors, dense or sparse."""
    kind = vectors.field("type").to_numpy(zero_copy_only=False)
    idx, val = vectors.field("indices"), vectors.field("values")
    size = val.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(vectors)), size)
    value = val.flatten().to_numpy(zero_copy_only=False)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    column = place.copy()
    column[kind[row] == 0] = idx.flatten().to_numpy(zero_copy_only=False)
    keep = value != 0
    return row[keep], column[keep], value[keep]


@dataclass
class Layout:
    """Cells (feature, bin) of the kept features; bin b holds edges[b - 1] < x <= edges[b]."""

    features: np.ndarray                       # column of each kept feature, ascending
    edges: list[np.ndarray]

    def __post_init__(self):
        self.bins = np.array([len(e) + 1 for e in self.edges], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.bins)]).astype(np.int64)
        self.of = np.repeat(np.arange(len(self.edges)), self.bins)             # feature of a cell
        self.zero = np.array([np.searchsorted(e, 0.0, "left") for e in self.edges], np.int64)
        flat = [(f, v) for f, e in enumerate(self.edges) for v in e]
        # complex numbers order by real, then imaginary part: one search finds the bin of any (feature, value)
        self._flat = np.array([complex(f, v) for f, v in flat])
        self._first = np.concatenate([[0], np.cumsum(self.bins - 1)]).astype(np.int64)
        self.blocks = self._cut()

    @property
    def cells(self) -> int:
        return int(self.start[-1])

    def _cut(self) -> list[tuple[int, int]]:
        """Ranges of features whose cells form a block."""
        out, a = [], 0
        for f in range(len(self.edges)):
            if self.start[f + 1] - self.start[a] > BLOCK_CELLS and f > a:
                out.append((a, f))
                a = f
        return out + [(a, len(self.edges))] if len(self.edges) else []

    def codes(self, row, column, value) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the entries that are not in their feature's zero bin."""
        f = np.searchsorted(self.features, column)
        f[f == len(self.features)] = 0
        known = self.features[f] == column if len(self.features) else np.zeros(len(column), bool)
        row, f, value = row[known], f[known], value[known]
        b = np.searchsorted(self._flat, f + 1j * value, "left") - self._first[f]
        keep = b != self.zero[f]
        return row[keep], (self.start[f] + b)[keep]

    def matrix(self, n: int, row: np.ndarray, cell: np.ndarray, use: np.ndarray) -> np.ndarray:
        """(n, len(use)) bins of the features ``use``."""
        out = np.tile(self.zero[use].astype(np.int16), (n, 1))
        slot = np.full(len(self.edges), -1)
        slot[use] = np.arange(len(use))
        s = slot[self.of[cell]]
        at = s >= 0
        out[row[at], s[at]] = (cell - self.start[self.of[cell]])[at]
        return out


def fit_layout(x: DataFrame, p: BoostingParams, rows_per_bin: int | None = ROWS_PER_BIN) -> Layout:
    """Quantile edges of every feature, from one aggregate over what is not zero.  A bin should have ``rows_per_bin``
    non-zero rows; None: its share of all rows, as if the quantiles were those of all values."""
    def spread(it):
        for b in it:
            _, column, value = entries(b["features"])
            yield pa.RecordBatch.from_arrays([pa.array(column.astype(np.int32)), pa.array(value)], names=["f", "v"])
    shares = [(i + 1) / p.max_bin for i in range(p.max_bin - 1)]
    stats = (x.select("features").mapInArrow(spread, "f int, v double").groupBy("f")
             .agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"), F.percentile_approx("v", shares, 10_000).alias("q"))
             .filter(F.col("n") >= p.min_rows))
    n_rows = x.count()
    least = rows_per_bin or max(1, n_rows // p.max_bin)
    features, edges = [], []
    for r in stats.orderBy("f").collect():                     # one row per feature, ``max_bin`` numbers each
        want = int(np.clip(r["n"] // least, 1, p.max_bin - 1))
        pick = np.unique(np.linspace(0, len(shares) - 1, want).round().astype(int)) if want > 1 else [len(shares) // 2]
        e = {r["q"][i] for i in pick} | ({0.0} if r["n"] < n_rows else set())
        e = np.array(sorted(v for v in e if v < max(r["top"], 0.0 if r["n"] < n_rows else -np.inf)))
        if len(e):
            features.append(r["f"])
            edges.append(e)
    return Layout(np.array(features, np.int64), edges)


# --------------------------------------------------------------------- trees
@dataclass
class Nodes:
    """Nodes of some trees as parallel arrays; children of node i are 2 i + 1 (x <= threshold) and 2 i + 2."""

    turn: list = field(default_factory=list)
    cls: list = field(default_factory=list)
    node: list = field(default_factory=list)
    feature: list = field(default_factory=list)               # -1: leaf
    threshold: list = field(default_factory=list)
    value: list = field(default_factory=list)                 # of a leaf
    cover: list = field(default_factory=list)                 # hessian of the rows that reach the node

    def add(self, turn, cls, node, feature, threshold, value, cover):
        for name, v in zip(NODE_FIELDS, (turn, cls, node, feature, threshold, value, cover)):
            getattr(self, name).append(v)


NODE_FIELDS = ("turn", "cls", "node", "feature", "threshold", "value", "cover")
NODE_SCHEMA = "turn int, cls int, node int, feature int, threshold double, value double, cover double"


class Forest:
    """Trees laid out for whole batches: per round (class, node) matrices of feature slot, bin and value."""

    def __init__(self, layout: Layout, nodes: Nodes, n_classes: int):
        self.layout, self.n_classes = layout, n_classes
        turn, cls, node, feature = (np.array(getattr(nodes, k), np.int64) for k in ("turn", "cls", "node", "feature"))
        threshold, value = np.array(nodes.threshold, float), np.array(nodes.value, float)
        inner = feature >= 0
        kept = np.searchsorted(layout.features, feature[inner])
        self.use = np.unique(kept)
        slot, bins = np.full(len(node), -1, np.int32), np.zeros(len(node), np.int16)
        slot[inner] = np.searchsorted(self.use, kept)
        bins[inner] = np.searchsorted(layout._flat, kept + 1j * threshold[inner], "left") - layout._first[kept]
        self.rounds = []
        for t in np.unique(turn):
            at = turn == t
            width = int(node[at].max()) + 1
            f, b, v = np.full((n_classes, width), -1, np.int32), np.zeros((n_classes, width), np.int16), np.zeros((n_classes, width))
            f[cls[at], node[at]], b[cls[at], node[at]], v[cls[at], node[at]] = slot[at], bins[at], value[at]
            self.rounds.append((f, b, v))

    def reached(self, bins: np.ndarray, t: int) -> np.ndarray:
        """(rows, classes) node each row ends in, in round ``t``."""
        f, b, _ = self.rounds[t]
        cls = np.arange(self.n_classes)[None, :]
        at = np.zeros((len(bins), self.n_classes), np.int64)
        while True:
            slot = f[cls, at]
            go = slot >= 0
            if not go.any():
                return at
            right = np.take_along_axis(bins, np.maximum(slot, 0), 1) > b[cls, at]
            at = np.where(go, 2 * at + 1 + right, at)

    def margins(self, n: int, row: np.ndarray, cell: np.ndarray) -> np.ndarray:
        total = np.zeros((n, self.n_classes))
        if self.rounds:
            bins = self.layout.matrix(n, row, cell, self.use)
            for t, (_, _, v) in enumerate(self.rounds):
                total += np.take_along_axis(v.T, self.reached(bins, t), 0)
        return total


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(prob: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole multiples of 1 / SCALE: gradient and hessian of the log loss per row and class."""
    hit = label[:, None] == np.arange(prob.shape[1])[None, :]
    w = weight[:, None]
    return np.rint((prob - hit) * w * SCALE), np.rint(2.0 * prob * (1.0 - prob) * w * SCALE)


def leaf_weight(g, h, p: BoostingParams):
    """Newton step with both penalties, bounded by ``max_delta_step``."""
    w = -np.sign(g) * np.maximum(np.abs(g) - p.reg_alpha, 0.0) / (h + p.reg_lambda + 1e-12)
    return np.clip(w, -p.max_delta_step, p.max_delta_step) if p.max_delta_step > 0 else w


def score(g, h, p: BoostingParams):
    """What a leaf of these sums takes off the loss, doubled."""
    w = leaf_weight(g, h, p)
    return -(2.0 * g * w + (h + p.reg_lambda) * w * w + 2.0 * p.reg_alpha * np.abs(w))


def best_split(layout: Layout, block: tuple[int, int], g: np.ndarray, h: np.ndarray, total_g: float, total_h: float,
               ok: np.ndarray, p: BoostingParams) -> tuple[float, int, float, float] | None:
    """(gain, cell, left g, left h) of the best split x <= edge of a block's cells; ties to the first cell.  ``g`` and
    ``h`` are whole numbers without the zero bins."""
    a, z = block
    lo = int(layout.start[a])
    first = (layout.start[a:z] - lo).astype(np.int64)
    g, h = g.astype(np.float64), h.astype(np.float64)
    for v, total in ((g, total_g), (h, total_h)):
        v[first + layout.zero[a:z]] += total - np.add.reduceat(v, first)
    of = layout.of[lo:lo + len(g)] - a
    left_g, left_h = np.cumsum(g), np.cumsum(h)
    left_g, left_h = left_g - (left_g - g)[first][of], left_h - (left_h - h)[first][of]
    inner = np.ones(len(g), bool)
    inner[np.append(first[1:], len(g)) - 1] = False            # after the last bin of a feature there is no edge
    at = np.flatnonzero(inner & ok[layout.of[lo:lo + len(g)]])
    lg, lh, tg, th = left_g[at] / SCALE, left_h[at] / SCALE, total_g / SCALE, total_h / SCALE
    fine = (lh >= p.min_child_weight) & (th - lh >= p.min_child_weight) & (lh > 0) & (th - lh > 0)
    at, lg, lh = at[fine], lg[fine], lh[fine]
    if not len(at):
        return None
    gain = score(lg, lh, p) + score(tg - lg, th - lh, p) - score(tg, th, p)
    i = int(gain.argmax())
    return float(gain[i]), lo + int(at[i]), float(left_g[at[i]]), float(left_h[at[i]])


# ----------------------------------------------------------------------- fit
_ROW = "label int, weight double, held boolean, key long, cells array<int>, margin array<double>"


class SoftmaxBoosting:
    """Estimator over columns ``features`` (ML vectors) and ``label``; ``weight`` and ``held`` are optional."""

    def __init__(self, **params):
        self.params = BoostingParams(**params)

    def fit(self, x: DataFrame) -> "SoftmaxModel":
        p, spark = self.params, x.sparkSession
        key = F.xxhash64("features", "label")
        held = F.col("held") if "held" in x.columns else \
            (F.pmod(F.xxhash64(key, F.lit(p.seed)), F.lit(1000)) < int(1000 * p.held_share)) if p.patience else F.lit(False)
        weight = F.col("weight").cast("double") if "weight" in x.columns else F.lit(1.0)
        x = x.select(F.col("label").cast("int").alias("label"), weight.alias("weight"),
                     F.coalesce(held, F.lit(False)).alias("held"), key.alias("key"), "features")
        top = x.agg(F.max("label")).first()[0]
        if top is None:
            raise ValueError("no rows to fit on")
        n_classes = top + 1
        layout = fit_layout(x.filter(~F.col("held")), p)
        n = x.count()
        tasks = max(-(-n // TASK_ROWS), min(spark.sparkContext.defaultParallelism, -(-n // 256)))
        rows = written(x.repartition(tasks, "key").mapInArrow(_binner(spark.sparkContext.broadcast(layout), n_classes), _ROW), "boosting-rows")
        done, recent, losses = Nodes(), Nodes(), []
        for turn in range(p.n_estimators):
            trees, loss = _grow(rows, layout, recent, n_classes, turn, p)
            losses.append(loss)                                # of the trees before this round
            if p.patience and _stalled(losses, p.patience):
                break
            for name in NODE_FIELDS:
                for nodes in (done, recent):
                    getattr(nodes, name).extend(getattr(trees, name))
            if (turn + 1) % CHECKPOINT == 0:
                rows = written(rows.mapInArrow(_stepper(spark.sparkContext.broadcast((layout, recent)), n_classes), _ROW), "boosting-rows")
                recent = Nodes()
        else:
            losses.append(_losses(rows, layout, recent, n_classes))
        # losses[i] belongs to the model of i rounds
        keep = int(np.argmin([held for _, held in losses])) if p.patience and losses[0][1] is not None else len(losses) - 1
        return SoftmaxModel(spark, n_classes, _first_rounds(done, keep), losses, p)


def _stalled(losses: list, patience: int) -> bool:
    held = [v for _, v in losses]
    return held[0] is not None and len(held) - 1 - int(np.argmin(held)) >= patience


def _first_rounds(nodes: Nodes, rounds: int) -> Nodes:
    at = [i for i, t in enumerate(nodes.turn) if t < rounds]
    return Nodes(**{k: [getattr(nodes, k)[i] for i in at] for k in NODE_FIELDS})


def _cells_column(n: int, row: np.ndarray, cell: np.ndarray) -> pa.Array:
    by = np.lexsort((cell, row))
    offsets = np.searchsorted(row[by], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell[by].astype(np.int32)))


def _margin_column(m: np.ndarray) -> pa.Array:
    offsets = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m).reshape(-1)))


def _binner(shared, n_classes: int):
    def run(it):
        for b in it:
            row, cell = shared.value.codes(*entries(b["features"]))
            yield pa.RecordBatch.from_arrays(
                [b["label"], b["weight"], b["held"], b["key"], _cells_column(b.num_rows, row, cell),
                 _margin_column(np.zeros((b.num_rows, n_classes)))], names=["label", "weight", "held", "key", "cells", "margin"])
    return run


def _pieces(it):
    for b in it:
        for a in range(0, b.num_rows, BATCH):
            yield b.slice(a, BATCH)


def _opened(b: pa.RecordBatch, n_classes: int):
    """(label, weight, held, key, row, cell, margin) of a batch of binned rows."""
    label, weight, held, key = (b[c].to_numpy(zero_copy_only=False) for c in ("label", "weight", "held", "key"))
    size = b["cells"].value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(b.num_rows), size)
    cell = b["cells"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return label, weight, held, key, row, cell, b["margin"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, n_classes)


def _stepper(shared, n_classes: int):
    def run(it):
        layout, recent = shared.value
        forest = Forest(layout, recent, n_classes)
        for b in _pieces(it):
            *_, row, cell, margin = _opened(b, n_classes)
            yield b.set_column(b.schema.get_field_index("margin"), "margin", _margin_column(margin + forest.margins(b.num_rows, row, cell)))
    return run


_PART = "j int, block int, g long, h long, cell binary, cg binary, ch binary"


def _loss_rows(prob, label, weight, held):
    """Rows j = -1 (fitted) and -2 (held): rounded log loss and weight."""
    loss = -np.log(np.maximum(prob[np.arange(len(label)), label], 1e-15)) * weight
    out = []
    for j, part in ((-1, ~held), (-2, held)):
        if part.any():
            out.append((j, -1, int(np.rint(loss[part] * SCALE).sum()), int(np.rint(weight[part] * SCALE).sum()), b"", b"", b""))
    return out


def _rows_batch(rows: list) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    names = ["j", "block", "g", "h", "cell", "cg", "ch"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _histograms(shared, n_classes: int, turn: int, p: BoostingParams):
    """One level of all classes: sums per open node and cell, sent by (node, block).

    The rows of a task are held, ``HOLD_ROWS`` at a time, and each class sums them in one go, so a task sends a node once
    and holds the sums of few nodes at once (``ACCUMULATE``).  Cells of features the level may not split on are not sent."""
    def run(it):
        layout, recent, grown, level, open_nodes = shared.value
        forest = Forest(layout, recent, n_classes)
        tree = Forest(layout, grown, n_classes)
        slot = np.full((n_classes, 2 ** (level + 1) - 1), -1)
        per_class = [[] for _ in range(n_classes)]
        for j, (c, node) in enumerate(open_nodes):
            slot[c, node] = len(per_class[c])
            per_class[c].append(j)
        n_cells = layout.cells
        at_once = max(1, ACCUMULATE // max(n_cells, 1))        # nodes of a class whose sums are held at once
        may = [np.flatnonzero(allowed(p, len(layout.edges), turn, c, level)[layout.of]) for c in range(n_classes)]
        lost: dict[int, tuple] = {}

        def held_rows():
            """(gradients, hessians, node numbers, row and cell of the entries) of rows that take part."""
            parts, n = [], 0
            for b in _pieces(it):
                label, weight, held, key, row, cell, margin = _opened(b, n_classes)
                prob = softmax(margin + forest.margins(b.num_rows, row, cell))
                if level == 0:
                    for r in _loss_rows(prob, label, weight, held):
                        old = lost.get(r[0], (0, 0))
                        lost[r[0]] = (old[0] + r[2], old[1] + r[3])
                g, h = gradients(prob, label, weight)
                use = ~held & in_sample(p, key, turn)
                at = np.zeros((b.num_rows, n_classes), np.int64)
                if grown.node:
                    at = tree.reached(layout.matrix(b.num_rows, row, cell, tree.use), 0)
                place = slot[np.arange(n_classes)[None, :], np.minimum(at, slot.shape[1] - 1)]
                e = use[row]
                number = np.cumsum(use) - 1                    # of a row among those that take part
                parts.append((g[use], h[use], place[use].astype(np.int32), (number[row[e]] + n).astype(np.int32), cell[e].astype(np.int32)))
                n += int(use.sum())
                if n >= HOLD_ROWS:
                    yield [np.concatenate(v) for v in zip(*parts)]
                    parts, n = [], 0
            if n:
                yield [np.concatenate(v) for v in zip(*parts)]

        def rows_of(nodes, totals, sums, send):
            cg, ch = sums
            for i, j in enumerate(nodes):
                if not totals[1][i] and not totals[2][i]:
                    continue
                cells = send[(cg[i, send] != 0) | (ch[i, send] != 0)]
                cuts = np.searchsorted(cells, [layout.start[a] for a, _ in layout.blocks] + [n_cells])
                for k, (a, _) in enumerate(layout.blocks):
                    at = cells[cuts[k]:cuts[k + 1]]
                    yield (j, k, int(totals[0][i]), int(totals[1][i]), (at - layout.start[a]).astype(np.int32).tobytes(),
                           cg[i, at].astype(np.int64).tobytes(), ch[i, at].astype(np.int64).tobytes())

        for g, h, place, row, cell in held_rows():
            for c in range(n_classes):
                gc, hc, pc = (np.ascontiguousarray(v[:, c]) for v in (g, h, place))
                for first in range(0, len(per_class[c]), at_once):
                    nodes = per_class[c][first:first + at_once]
                    m = len(nodes)
                    # rows in other nodes are summed in a last one, which is not sent
                    pm = np.where((pc >= first) & (pc < first + m), pc - first, m).astype(np.int64)
                    if (pm == m).all():
                        continue
                    idx = (pm * n_cells)[row] + cell
                    totals = [np.bincount(pm, v, m + 1)[:m] for v in (gc, hc, np.ones(len(pm)))]
                    sums = [np.bincount(idx, v[row], (m + 1) * n_cells).reshape(m + 1, n_cells)[:m] for v in (gc, hc)]
                    out = list(rows_of(nodes, totals, sums, may[c]))
                    if out:
                        yield _rows_batch(out)
        if lost:
            yield _rows_batch([(j, -1, loss, w, b"", b"", b"") for j, (loss, w) in lost.items()])
    return run


def _reducer(shared, turn: int, p: BoostingParams):
    """Adds up the rows of each (node, block) as a stream and finds the best split of the block."""
    def run(it):
        layout, _, _, level, open_nodes = shared.value
        now, g, h, cg, ch = None, 0, 0, None, None

        def settle():
            j, k = now
            if k < 0:
                return (j, k, g, h, None, None, None, None)
            ok = allowed(p, len(layout.edges), turn, open_nodes[j][0], level)
            found = best_split(layout, layout.blocks[k], cg, ch, g, h, ok, p)
            return (j, k, g, h, *(found or (None, None, None, None)))
        out = []
        for b in it:
            for j, k, dg, dh, cell, vg, vh in zip(*(b[c].to_pylist() for c in ("j", "block", "g", "h", "cell", "cg", "ch"))):
                if (j, k) != now:
                    if now is not None:
                        out.append(settle())
                    now, g, h = (j, k), 0, 0
                    if k >= 0:
                        a, z = layout.blocks[k]
                        cg, ch = (np.zeros(int(layout.start[z] - layout.start[a]), np.int64) for _ in range(2))
                g, h = g + dg, h + dh
                if k >= 0:
                    at = np.frombuffer(cell, np.int32)
                    cg[at] += np.frombuffer(vg, np.int64)
                    ch[at] += np.frombuffer(vh, np.int64)
        if now is not None:
            out.append(settle())
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)],
                                         names=["j", "block", "g", "h", "gain", "cell", "lg", "lh"])
    return run


_BEST = "j int, block int, g long, h long, gain double, cell long, lg double, lh double"


def _grow(rows: DataFrame, layout: Layout, recent: Nodes, n_classes: int, turn: int, p: BoostingParams):
    """(trees of the round, losses before it): one job a level, for all classes together."""
    spark = rows.sparkSession
    grown, loss = Nodes(), {}
    open_nodes = [(c, 0) for c in range(n_classes)]
    for level in range(p.max_depth):
        shared = spark.sparkContext.broadcast((layout, recent, grown, level, open_nodes))
        sums = rows.mapInArrow(_histograms(shared, n_classes, turn, p), _PART)
        best = (sums.repartition("j", "block").sortWithinPartitions("j", "block")
                .mapInArrow(_reducer(shared, turn, p), _BEST).collect())       # open nodes x blocks
        shared.destroy()
        if level == 0:
            loss = {r["j"]: r["g"] / max(r["h"], 1) for r in best if r["j"] < 0}
        top: dict[int, tuple] = {}
        totals: dict[int, tuple] = {}
        for r in best:
            if r["j"] >= 0:
                totals[r["j"]] = (r["g"], r["h"])
                if r["gain"] is not None:
                    top[r["j"]] = min(top.get(r["j"], (np.inf,)), (-r["gain"], r["cell"], r["lg"], r["lh"]))
        # children were added as leaves; one that splits becomes an inner node
        at = {(c, n): i for i, (c, n) in enumerate(zip(grown.cls, grown.node))}
        following = []
        for j, (c, node) in enumerate(open_nodes):
            g, h = (v / SCALE for v in totals.get(j, (0, 0)))
            if (c, node) not in at:
                at[c, node] = len(grown.node)
                grown.add(turn, c, node, -1, 0.0, p.learning_rate * float(leaf_weight(g, h, p)), h)
            if j not in top or -top[j][0] <= max(p.gamma, 1e-9):
                continue
            _, cell, lg, lh = top[j]
            f = int(layout.of[cell])
            i = at[c, node]
            grown.feature[i], grown.value[i] = int(layout.features[f]), 0.0
            grown.threshold[i] = float(layout.edges[f][cell - layout.start[f]])
            for child, cg, ch in ((2 * node + 1, lg / SCALE, lh / SCALE), (2 * node + 2, g - lg / SCALE, h - lh / SCALE)):
                grown.add(turn, c, child, -1, 0.0, p.learning_rate * float(leaf_weight(cg, ch, p)), ch)
                if ch >= 2 * p.min_child_weight:
                    following.append((c, child))
        if not following:
            break
        open_nodes = following
    return grown, (loss.get(-1), loss.get(-2))


def _losses(rows: DataFrame, layout: Layout, recent: Nodes, n_classes: int) -> tuple:
    """(mean log loss of the fitted rows, of the held rows) under all trees."""
    shared = rows.sparkSession.sparkContext.broadcast((layout, recent))

    def run(it):
        forest = Forest(*shared.value, n_classes)
        for b in _pieces(it):
            label, weight, held, _, row, cell, margin = _opened(b, n_classes)
            yield _rows_batch(_loss_rows(softmax(margin + forest.margins(b.num_rows, row, cell)), label, weight, held))
    got = {r["j"]: r["g"] / max(r["h"], 1) for r in rows.mapInArrow(run, _PART).groupBy("j").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}
    return got.get(-1), got.get(-2)


# --------------------------------------------------------------------- model
class SoftmaxModel:
    """Fitted trees.  ``losses[i]``: mean log loss (fitted rows, held rows) after i rounds."""

    def __init__(self, spark: SparkSession, n_classes: int, nodes: Nodes, losses: list, params: BoostingParams):
        self.spark, self.n_classes, self.nodes, self.losses, self.params = spark, n_classes, nodes, losses, params
        used: dict[int, set] = {}
        for f, t in zip(nodes.feature, nodes.threshold):
            if f >= 0:
                used.setdefault(f, set()).add(t)
        names = sorted(used)
        self.layout = Layout(np.array(names, np.int64), [np.array(sorted(used[f])) for f in names])

    @property
    def n_rounds(self) -> int:
        return len(set(self.nodes.turn))

    def transform(self, x: DataFrame) -> DataFrame:
        """``x`` with ``probability`` (a vector), per Arrow batch and without a shuffle."""
        shared = x.sparkSession.sparkContext.broadcast((self.layout, self.nodes))
        n_classes, names = self.n_classes, x.columns

        def run(it):
            forest = Forest(*shared.value, n_classes)
            for b in _pieces(it):
                row, cell = forest.layout.codes(*entries(b["features"]))
                values = _margin_column(softmax(forest.margins(b.num_rows, row, cell)))
                vector = pa.StructArray.from_arrays(
                    [pa.array(np.ones(b.num_rows, np.int8)), pa.nulls(b.num_rows, pa.int32()),
                     pa.nulls(b.num_rows, pa.list_(pa.int32())), values], names=["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([*[b[c] for c in names], vector], names=[*names, "probability"])
        return x.mapInArrow(run, T.StructType([*x.schema.fields, T.StructField("probability", VectorUDT(), False)]))

    def node_table(self) -> DataFrame:
        rows = list(zip(*(getattr(self.nodes, k) for k in NODE_FIELDS)))
        return self.spark.createDataFrame(rows, NODE_SCHEMA)

    def save(self, path: str) -> None:
        import json
        self.node_table().write.mode("overwrite").parquet(f"{path}/nodes")
        meta = {"n_classes": self.n_classes, "losses": self.losses, "params": asdict(self.params)}
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SoftmaxModel":
        import json
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        rows = spark.read.parquet(f"{path}/nodes").orderBy("turn", "cls", "node").collect()
        nodes = Nodes(**{k: [r[k] for r in rows] for k in NODE_FIELDS})
        return cls(spark, meta["n_classes"], nodes, [tuple(v) for v in meta["losses"]], BoostingParams(**meta["params"]))
