"""The forest of sparse counts against a plain version; classifiers are fitted on every row."""
import datetime

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ledgerlens.operators import attribution as at
from ledgerlens.operators import forest as fo
from ledgerlens.plans import learn


def sample(n=260, width=9, seed=1):
    rng = np.random.default_rng(seed)
    x = np.where(rng.uniform(size=(n, width)) < 0.5, 0.0, rng.normal(size=(n, width)).round(1))
    x[:, -1] = 3.0                                              # the same in every row
    return x, (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] + rng.normal(size=n) * 0.3 > 0.2)


def frame(spark, x, y):
    rows = [(i, float(c), Vectors.sparse(len(r), np.flatnonzero(r).tolist(), r[r != 0].tolist()) if i % 2 else Vectors.dense(r))
            for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["txn_id", "label", "features"])


def plain_forest(x, y, keys, layout, p, n_classes):
    """{(tree, node): (feature, threshold or 0, class weights)}, one node after the other, on dense rows."""
    out = {}
    for t in range(p.numTrees):
        w, todo = fo.bag(p, keys, t), [(0, np.arange(len(x)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            weigh = lambda r: np.bincount(y[r], w[r], n_classes)
            total, best = weigh(rows), None
            if depth < p.maxDepth and (total > 0).sum() > 1 and total.sum() >= 2 * p.minInstancesPerNode:
                for f in fo.draw_features(p, x.shape[1], p.drawn(x.shape[1]), t, node):
                    if f not in layout.features:
                        continue
                    for e in layout.edges[list(layout.features).index(f)]:
                        left, right = weigh(rows[x[rows, f] <= e]), weigh(rows[x[rows, f] > e])
                        if min(left.sum(), right.sum()) < p.minInstancesPerNode:
                            continue
                        impure = lambda c: c.sum() - (c * c).sum() / c.sum()
                        gain = (impure(total) - impure(left) - impure(right)) / total.sum()
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                            best = gain, f, e
            if best is None:
                out[t, node] = (-1, 0.0, total)
                continue
            _, f, e = best
            out[t, node] = (f, e, total)
            todo += [(2 * node + 1, rows[x[rows, f] <= e], depth + 1), (2 * node + 2, rows[x[rows, f] > e], depth + 1)]
    return out


@pytest.mark.parametrize("params", [dict(numTrees=4, maxDepth=4), dict(numTrees=3, maxDepth=3, maxBins=6, featureSubsetStrategy="0.7", minInstancesPerNode=9),
                                    dict(numTrees=1, maxDepth=2, featureSubsetStrategy="all")])
def test_forest_equals_plain_version(spark, params):
    x, y = sample()
    df = frame(spark, x, y)
    m = fo.RandomForest(**params).fit(df)
    p = m.params
    keys = np.array([r[0] for r in df.select(F.xxhash64(*df.columns)).collect()])
    layout = fo.fit_layout(df, fo._Bins(p.maxBins), rows_per_bin=None)
    assert x.shape[1] - 1 not in layout.features
    want = plain_forest(x, y, keys, layout, p, 4)
    got = {(t, n): (f, e, s) for t, n, f, e, s in zip(*(getattr(m.trees, k) for k in fo.TREE_FIELDS))}
    assert got.keys() == want.keys() and len(got) > 2 * p.numTrees
    assert all(got[k][:2] == want[k][:2] and (got[k][2] == want[k][2]).all() for k in want)
    for r in m.transform(df).select("txn_id", vector_to_array("probability").alias("p")).collect():
        votes = []
        for t in range(p.numTrees):
            node = 0
            while want[t, node][0] >= 0:
                node = 2 * node + 1 + (x[r["txn_id"], want[t, node][0]] > want[t, node][1])
            votes.append(want[t, node][2] / want[t, node][2].sum())
        assert np.allclose(r["p"], np.mean(votes, 0))


def test_forest_does_not_depend_on_partitions_or_memory(spark, tmp_path, monkeypatch):
    x, y = sample(seed=2)
    df = frame(spark, x, y)
    say = lambda m: sorted((t, n, f, e, tuple(s)) for t, n, f, e, s in zip(*(getattr(m.trees, k) for k in fo.TREE_FIELDS)))
    m = fo.RandomForest(numTrees=5, maxDepth=4).fit(df.coalesce(1))
    m.save(str(tmp_path / "forest"))
    again = fo.ForestModel.load(spark, str(tmp_path / "forest"))
    assert say(again) == say(m) and again.params == m.params
    for name in ("HOLD", "SEND", "CELLS"):
        monkeypatch.setattr(fo, name, 40)
    monkeypatch.setattr(fo, "TASK_ROWS", 50)
    assert say(fo.RandomForest(numTrees=5, maxDepth=4).fit(df.repartition(7))) == say(m)


def test_forest_of_odd_inputs(spark):
    x, y = sample(12)
    df = frame(spark, x, y)
    with pytest.raises(ValueError):
        fo.RandomForest().fit(df.limit(0))
    proba = lambda m: [list(r[0]) for r in m.transform(df).select(vector_to_array("probability")).collect()]
    one = fo.RandomForest(numTrees=3).fit(df.withColumn("label", F.lit(0.0)))
    assert proba(one) == [[1.0]] * 12 and set(one.trees.feature) == {-1}
    same = fo.RandomForest(numTrees=3).fit(frame(spark, np.ones((12, 3)), y))
    assert set(same.trees.feature) == {-1} and all(abs(sum(p) - 1) < 1e-12 for p in proba(same))
    stump = fo.RandomForest(numTrees=2, maxDepth=0).fit(df)
    assert len(stump.trees.tree) == 2 and at.forest_leaves(spark, stump)[0].feature.shape == (2, 0)
    # a tree whose bag is empty gives every class the same
    few = fo.RandomForest(numTrees=30, maxDepth=2).fit(df.limit(1))
    assert all(abs(sum(p) - 1) < 1e-12 for p in proba(few))
    with pytest.raises(ValueError):
        fo.RandomForest(numTrees=0)


def test_classifiers_are_fitted_on_every_row(spark, monkeypatch):
    """More rows than the former bound of 4,000, all of them in the fit."""
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, f"{401000 + i % 3}00", str(401000 + i % 3), f"VIR RECU {i % 7}", "PAIEMENT CB", "", 0.0, 10.0 + i % 50, day + datetime.timedelta(days=i % 300))
            for i in range(4600)]
    df = spark.createDataFrame(rows, "txn_id long, account_code string, target string, description string, remarks string, "
                                     "reference string, debit double, credit double, posting_date timestamp_ntz")

    class Counts:
        def fit(self, x):
            return x.count()
    monkeypatch.setattr(learn, "make_classifier", lambda kind, **params: Counts())
    for kind in ("forest", "logistic", "boosted"):
        assert learn.train(df, kind=kind, families=("numeric",)).classifier == 4600


def test_boosting_sends_a_node_once(monkeypatch):
    """A task sends a node's sums once, however little it holds, and no cells of features the level may not split on."""
    import pyarrow as pa

    from ledgerlens.operators import boosting as bo

    class Shared:
        def __init__(self, value):
            self.value = value
    rng = np.random.default_rng(5)
    n, width, classes = 64, 6, 3
    layout = bo.Layout(np.arange(width), [np.array([0.0, 0.5])] * width)
    x, label = rng.uniform(0.1, 1.0, (n, width)), rng.integers(0, classes, n)
    row, cell = layout.codes(np.repeat(np.arange(n), width), np.tile(np.arange(width), n), x.ravel())
    batch = pa.RecordBatch.from_arrays(
        [pa.array(label.astype(np.int32)), pa.array(np.ones(n)), pa.array(np.zeros(n, bool)), pa.array(np.arange(n)),
         bo._cells_column(n, row, cell), bo._margin_column(np.zeros((n, classes)))], names=["label", "weight", "held", "key", "cells", "margin"])
    p = bo.BoostingParams(subsample=1.0, colsample_bytree=0.5, colsample_bylevel=1.0)
    monkeypatch.setattr(bo, "ACCUMULATE", 1)
    monkeypatch.setattr(bo, "BATCH", 16)
    shared = Shared((layout, bo.Nodes(), bo.Nodes(), 0, [(c, 0) for c in range(classes)]))
    got = [r for b in bo._histograms(shared, classes, 0, p)([batch]) for r in b.to_pylist() if r["j"] >= 0]
    assert sorted((r["j"], r["block"]) for r in got) == [(c, 0) for c in range(classes)]
    for r in got:
        cells = np.frombuffer(r["cell"], np.int32)
        may = bo.allowed(p, width, 0, r["j"], 0)
        assert len(cells) and may[layout.of[cells]].all() and not may.all()
        g, _ = bo.gradients(np.full((n, classes), 1 / classes), label, np.ones(n))
        want = np.bincount(cell, g[row, r["j"]], layout.cells)
        assert (np.frombuffer(r["cg"], np.int64) == want[cells]).all()
