"""Exact additive attribution for tree models (X1, X3): Shapley values along all root-to-leaf paths.

A tree's expected value given some known features follows both children of an unknown split, weighted by the training
rows they cover.  The Shapley value of feature j for one leaf then has a closed form.  Let the path to the leaf test
the features i = 1..d, ``o_i`` be 1 if the row passes all tests of i and 0 otherwise, ``z_i`` the share of rows that
the tests of i keep, and v the leaf's value:

    phi_j = v (o_j - z_j) * integral over t in [0, 1] of prod over i <> j of (z_i (1 - t) + o_i t)

The integrand is a polynomial of degree d - 1, so Gauss-Legendre quadrature with (d + 1) / 2 points is exact.  All
leaves of a tree are rows of arrays (tests merged to one interval per feature), and an Arrow batch of rows is
attributed with array arithmetic.  Contributions add up to score minus expected score, for every row.

Node tables come from a ``ForestModel`` or a ``SoftmaxModel``; their size is bounded
by the model's parameters, and they are broadcast.  Rows do not move.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, LEAVES = 256, 128         # rows and leaves attributed at once


@dataclass
class Leaves:
    """Leaves of some trees with the same number of features on their paths: arrays (leaf, test) and values.

    ``cls`` is the class a leaf's value counts for, or -1 if ``value`` has one number per class."""

    feature: np.ndarray
    low: np.ndarray             # a row passes if low < x <= high
    high: np.ndarray
    share: np.ndarray           # of the covered rows that pass
    value: np.ndarray
    cls: np.ndarray


def leaf_paths(tree: dict, root: int = 0) -> list[tuple[dict, int]]:
    """(tests, leaf) of every leaf of ``tree``: {node: (feature, threshold, left, right, cover)}, feature -1 for a
    leaf.  Tests: {feature: (low, high, share)}."""
    out, stack = [], [(root, {})]
    while stack:
        node, tests = stack.pop()
        f, threshold, left, right, cover = tree[node]
        if f < 0:
            out.append((tests, node))
            continue
        low, high, share = tests.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((right, (max(low, threshold), high)), (left, (low, min(high, threshold)))):
            part = tree[child][4] / cover if cover > 0 else 0.5
            stack.append((child, {**tests, f: (*bounds, share * part)}))
    return out


def pack(paths: list[tuple[dict, np.ndarray | float, int]]) -> list[Leaves]:
    """Leaves (tests, value, class) grouped by their number of tests; leaves without tests (a tree of one node) add
    the same to every score and no contribution."""
    by: dict[int, list] = {}
    for tests, value, cls in paths:
        by.setdefault(len(tests), []).append((tests, value, cls))
    out = []
    for d, leaves in sorted(by.items()):
        keys = [list(t) for t, _, _ in leaves]
        col = lambda i: np.array([[t[f][i] for f in k] for (t, _, _), k in zip(leaves, keys)], float).reshape(len(leaves), d)
        out.append(Leaves(np.array(keys, np.int64).reshape(len(leaves), d), col(0), col(1), col(2),
                          np.array([v for _, v, _ in leaves], float), np.array([c for _, _, c in leaves], np.int64)))
    return out


def for_class(groups: list[Leaves], cls: int) -> list[Leaves]:
    """The leaves that count for a class, with one value each.  The others add nothing to its score."""
    out = []
    for g in groups:
        value = g.value[:, cls] if g.value.ndim == 2 else np.where(g.cls == cls, g.value, 0.0)
        at = np.flatnonzero(value)
        if len(at):
            out.append(Leaves(g.feature[at], g.low[at], g.high[at], g.share[at], value[at], np.full(len(at), cls)))
    return out


def attribute(groups: list[Leaves], x: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contributions (rows, features), scores, expected scores) of the rows ``x`` toward the classes ``cls``.  Rows of
    one class are worked out together, from the leaves that count for it."""
    n = len(x)
    phi, total, expected = np.zeros((n, x.shape[1])), np.zeros(n), np.zeros(n)
    for c in np.unique(cls):
        at = np.flatnonzero(cls == c)
        phi[at], total[at], expected[at] = attribute_class(for_class(groups, c), x[at])
    return phi, total, expected


def attribute_class(groups: list[Leaves], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``attribute`` of rows toward one class, given its leaves (``for_class``)."""
    n = len(x)
    phi, total, expected = np.zeros((n, x.shape[1])), np.zeros(n), np.zeros(n)
    for part in groups:
        d = part.feature.shape[1]
        t, w = np.polynomial.legendre.leggauss(max(1, (d + 1) // 2))
        t, w = (t + 1) / 2, w / 2
        bit = 1 << np.arange(d, dtype=np.int64)
        for a in range(0, len(part.feature), LEAVES):
            at = slice(a, a + LEAVES)
            f, share = part.feature[at], part.share[at]
            v = part.value[at]
            got = x[:, f]                                      # (rows, leaves, tests)
            passed = (got > part.low[at]) & (got <= part.high[at])
            total += (v * passed.all(2)).sum(1)
            expected += (v * share.prod(1)).sum()
            if not d:
                continue
            # rows that pass the same tests of a leaf have the same factors: each pattern is worked out once
            key = (passed @ bit) + (np.arange(len(f), dtype=np.int64) << d)
            pattern, of = np.unique(key, return_inverse=True)
            o, z = (pattern[:, None] & bit > 0).astype(float), share[pattern >> d]
            rest = np.zeros_like(z)
            for ti, wi in zip(t, w):
                term = z * (1 - ti) + o * ti
                rest += wi * term.prod(1, keepdims=True) / term
            part_phi = (v[pattern >> d, None] * (o - z) * rest)[of.reshape(key.shape)].reshape(n, -1)
            order = np.argsort(f, axis=None, kind="stable")
            column = f.reshape(-1)[order]
            first = np.flatnonzero(np.diff(column, prepend=-1))
            phi[:, column[first]] += np.add.reduceat(part_phi[:, order], first, axis=1)
    return phi, total, expected


# ---------------------------------------------------------------- node tables
def forest_leaves(spark: SparkSession, model) -> list[Leaves]:
    """Leaves of a ``ForestModel``: each tree gives its leaf's class distribution, divided by the trees."""
    trees: dict[int, dict] = {}
    value: dict[tuple, np.ndarray] = {}
    n, shares = model.trees, model.shares()
    for i, (t, node, f, threshold, stats) in enumerate(zip(n.tree, n.node, n.feature, n.threshold, n.stats)):
        trees.setdefault(t, {})[node] = (f, threshold, 2 * node + 1, 2 * node + 2, float(np.sum(stats)))
        value[t, node] = shares[i]
    return pack([(tests, value[t, leaf] / len(trees), -1) for t, tree in sorted(trees.items()) for tests, leaf in leaf_paths(tree)])


def boosted_leaves(model) -> list[Leaves]:
    """Leaves of a ``SoftmaxModel``: its scores are margins before the softmax."""
    trees: dict[tuple, dict] = {}
    value: dict[tuple, float] = {}
    n = model.nodes
    for turn, cls, node, f, threshold, v, cover in zip(n.turn, n.cls, n.node, n.feature, n.threshold, n.value, n.cover):
        trees.setdefault((turn, cls), {})[node] = (f, threshold, 2 * node + 1, 2 * node + 2, cover)
        value[turn, cls, node] = v
    return pack([(tests, value[*key, leaf], key[1]) for key, tree in sorted(trees.items()) for tests, leaf in leaf_paths(tree)])


def narrowed(groups: list[Leaves]) -> tuple[list[Leaves], np.ndarray]:
    """The same leaves over the features that occur, and the columns of these."""
    use = np.unique(np.concatenate([g.feature.reshape(-1) for g in groups])) if groups else np.zeros(0, np.int64)
    return [Leaves(np.searchsorted(use, g.feature), g.low, g.high, g.share, g.value, g.cls) for g in groups], use


TOP = "array<struct<feature:string,value:double,contribution:double>>"


def _attributed(model, df: DataFrame, keep: list[str], target_class: str | None):
    """(rows with features and probabilities, function over their batches): the function gives, for bounded pieces,
    (batch, class, probabilities, feature names, features, contributions, scores, expected scores)."""
    from pyspark.ml.functions import vector_to_array

    from .boosting import entries
    classes, names = model.classes, model.features.feature_names()
    if target_class is not None and target_class not in classes:
        raise ValueError(f"this model has no class {target_class!r}")
    spark = df.sparkSession
    groups, use = narrowed(forest_leaves(spark, model.classifier) if model.kind == "forest" else boosted_leaves(model.classifier))
    chosen = None if target_class is None else classes.index(target_class)
    scored = model.classifier.transform(model.features.transform(df, keep=keep))
    shared = spark.sparkContext.broadcast((groups, use, [names[i] for i in use]))

    def each(it):
        groups, use, names = shared.value
        own: dict[int, list[Leaves]] = {}                       # leaves of the classes that occurred
        for whole in it:
            prob = whole["probability"].flatten().to_numpy(zero_copy_only=False).reshape(whole.num_rows, -1)
            c = prob.argmax(1) if chosen is None else np.full(whole.num_rows, chosen)
            # rows of a class stand together
            by = np.argsort(c, kind="stable")
            whole, prob, c = whole.take(pa.array(by)), prob[by], c[by]
            starts = np.flatnonzero(np.diff(c, prepend=-1))
            for lo, hi in zip(starts, [*starts[1:], len(c)]):
                if c[lo] not in own:
                    own[c[lo]] = for_class(groups, c[lo])
                leaves = own[c[lo]]
                for a in range(lo, hi, ROWS):
                    z = min(a + ROWS, hi)
                    b = whole.slice(a, z - a)
                    row, column, value = entries(b["features"])
                    s = np.minimum(np.searchsorted(use, column), max(len(use) - 1, 0))
                    on = use[s] == column if len(use) else np.zeros(len(column), bool)
                    dense = np.zeros((b.num_rows, len(use)))
                    dense[row[on], s[on]] = value[on]
                    yield b, c[a:z], prob[a:z], names, dense, *attribute_class(leaves, dense)
    return scored.select(*keep, "features", vector_to_array("probability").alias("probability")), each


def explain_trees(model, df: DataFrame, keep: list[str], target_class: str | None = None, n: int = 10) -> DataFrame:
    """X1-X3 of a fitted tree ``LedgerModel`` (forest or boosted): ``keep``, ``code`` (predicted class, or the chosen
    one), ``confidence``, ``margin`` = score minus expected score, ``total`` = sum of all contributions (equal to it),
    and ``top``, the ``n`` largest by size (ties: earlier feature) with names and values.

    A forest's score is the class probability, a boosted model's the margin before the softmax."""
    x, each = _attributed(model, df, keep, target_class)
    classes = model.classes

    def run(it):
        for b, c, prob, names, dense, phi, score, expected in each(it):
            best = np.argsort(-np.abs(phi), axis=1, kind="stable")[:, :n]
            flat, at = best.ravel(), np.repeat(np.arange(b.num_rows), best.shape[1])
            tops = pa.ListArray.from_arrays(
                pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * best.shape[1]),
                pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(flat)), pa.array(dense[at, flat]),
                                            pa.array(phi[at, flat])], names=["feature", "value", "contribution"]))
            yield pa.RecordBatch.from_arrays(
                [*[b[k] for k in keep], pa.array([classes[i] for i in c], pa.string()),
                 pa.array(prob[np.arange(b.num_rows), c]), pa.array(score - expected), pa.array(phi.sum(1)), tops],
                names=[*keep, "code", "confidence", "margin", "total", "top"])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields if f.name in keep]
    return x.mapInArrow(run, ", ".join([*fields, "code string, confidence double, margin double, total double", f"top {TOP}"]))


def tree_importance(model, df: DataFrame, top: int = 20) -> DataFrame:
    """X4 of a fitted tree model: mean size of the contributions toward the predicted class, largest first (ties:
    name).  Tasks send one sum per feature."""
    x, each = _attributed(model, df, [], None)

    def run(it):
        total, n = None, 0
        for b, _, _, names, _, phi, _, _ in each(it):
            total, n = np.abs(phi).sum(0) + (0 if total is None else total), n + b.num_rows
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([*names, None], pa.string()), pa.array([*total, float(n)])], names=["feature", "v"])
    sums = x.mapInArrow(run, "feature string, v double").groupBy("feature").agg(F.sum("v").alias("v"))
    rows = sums.agg(F.max(F.when(F.col("feature").isNull(), F.col("v"))).alias("n"))
    return (sums.filter("feature is not null").select("feature", (F.col("v") / F.lit(rows.first()["n"])).alias("importance"))
            .orderBy(F.desc("importance"), "feature").limit(top))
