"""Joint boosting against a plain version, path attribution against enumeration of subsets, pruning of trials."""
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ledgerlens.operators import attribution as at
from ledgerlens.operators import boosting as bo
from ledgerlens.operators import normalize as nz
from ledgerlens.operators import split as sp
from ledgerlens.plans import learn, tuning
from ledgerlens.sources.ledger import ledger_frame


def sample(n=200, seed=3, classes=4):
    """Dense, sparse, binary and signed columns; labels follow them with noise; weights; a held part."""
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.random(n) * (rng.random(n) < 0.4), (rng.random(n) < 0.3) * 1.0,
                  rng.integers(0, 9, n) * 1.0, np.zeros(n), -rng.random(n)], 1)
    y = ((x[:, 0] > 0) * 2 + (x[:, 3] > 4)).astype(int) % classes
    y[rng.random(n) < 0.1] = classes - 1
    return x, y, rng.choice([0.5, 1.0, 3.0], n), rng.random(n) < 0.25


def frame(spark, x, y, w, held, sparse=False):
    row = (lambda v: Vectors.sparse(len(v), [(i, float(a)) for i, a in enumerate(v) if a])) if sparse else Vectors.dense
    return spark.createDataFrame([(i, int(y[i]), float(w[i]), bool(held[i]), row(x[i])) for i in range(len(x))],
                                 ["txn_id", "label", "weight", "held", "features"])


def plain_boosting(x, y, w, held, keys, p, layout, n_classes):
    """The same trees by loops over rows and edges."""
    margin = np.zeros((len(x), n_classes))
    losses = []
    slot = {int(f): i for i, f in enumerate(layout.features)}

    def lose(rows):
        prob = bo.softmax(margin)
        return float((-np.log(prob[rows, y[rows]]) * w[rows]).sum() / w[rows].sum())
    for turn in range(p.n_estimators):
        losses.append((lose(~held), lose(held)))
        prob = bo.softmax(margin)
        g, h = bo.gradients(prob, y, w)
        use = ~held & bo.in_sample(p, keys, turn)
        step = np.zeros_like(margin)
        for c in range(n_classes):
            open_nodes = [(0, np.ones(len(x), bool), 0)]
            while open_nodes:
                node, mine, level = open_nodes.pop()
                fit = mine & use
                tg, th = g[fit, c].sum() / bo.SCALE, h[fit, c].sum() / bo.SCALE
                best = None
                ok = bo.allowed(p, len(layout.edges), turn, c, level)
                if level < p.max_depth and (level == 0 or th >= 2 * p.min_child_weight):
                    for f in layout.features:
                        if not ok[slot[int(f)]]:
                            continue
                        for e in layout.edges[slot[int(f)]]:
                            left = fit & (x[:, f] <= e)
                            lg, lh = g[left, c].sum() / bo.SCALE, h[left, c].sum() / bo.SCALE
                            if lh < p.min_child_weight or th - lh < p.min_child_weight or lh <= 0 or th - lh <= 0:
                                continue
                            gain = float(bo.score(lg, lh, p) + bo.score(tg - lg, th - lh, p) - bo.score(tg, th, p))
                            if best is None or gain > best[0]:
                                best = (gain, int(f), e)
                if best is None or best[0] <= max(p.gamma, 1e-9):
                    step[mine, c] = p.learning_rate * float(bo.leaf_weight(tg, th, p))
                    continue
                _, f, e = best
                open_nodes += [(2 * node + 1, mine & (x[:, f] <= e), level + 1), (2 * node + 2, mine & (x[:, f] > e), level + 1)]
        margin += step
    losses.append((lose(~held), lose(held)))
    return margin, losses


@pytest.mark.parametrize("params", [
    dict(n_estimators=11, max_depth=3, patience=None),
    dict(n_estimators=4, max_depth=4, patience=None, subsample=0.6, colsample_bytree=0.7, colsample_bylevel=0.7,
         reg_alpha=0.3, reg_lambda=2.0, min_child_weight=1.0, gamma=0.2, max_delta_step=0.5, max_bin=8)])
def test_boosting_equals_plain_version(spark, params, monkeypatch):
    monkeypatch.setattr(bo, "BLOCK_CELLS", 12)                     # several blocks
    x, y, w, held = sample()
    df = frame(spark, x, y, w, held, sparse=True).repartition(3)
    est = bo.SoftmaxBoosting(min_rows=3, **params)
    model = est.fit(df)
    layout = bo.fit_layout(df.filter(~F.col("held")), est.params)
    keys = {r["txn_id"]: r["k"] for r in df.select("txn_id", F.xxhash64("features", "label").alias("k")).collect()}
    margin, losses = plain_boosting(x, y, w, held, np.array([keys[i] for i in range(len(x))]), est.params, layout, 4)
    from pyspark.ml.functions import vector_to_array
    got = {r["txn_id"]: r["p"] for r in model.transform(df).select("txn_id", vector_to_array("probability").alias("p")).collect()}
    assert np.allclose([got[i] for i in range(len(x))], bo.softmax(margin), atol=1e-9)
    assert np.allclose(model.losses, losses, atol=1e-6) and len(layout.blocks) > 1
    assert {f for f in model.nodes.feature if f >= 0} <= set(layout.features.tolist()) and 4 not in layout.features


def test_boosting_does_not_depend_on_partitions_or_memory(spark, monkeypatch):
    x, y, w, held = sample(150, 5)
    df = frame(spark, x, y, w, held)
    tables = []
    for parts, room, rows in ((1, 4 << 20, 2048), (7, 0, 16)):     # all in one task; batch by batch in seven
        monkeypatch.setattr(bo, "ACCUMULATE", room)
        monkeypatch.setattr(bo, "BATCH", rows)
        m = bo.SoftmaxBoosting(n_estimators=3, min_rows=2, patience=None).fit(df.repartition(parts))
        tables.append(list(zip(*(getattr(m.nodes, k) for k in bo.NODE_FIELDS))))
    assert sorted(tables[0]) == sorted(tables[1])


def test_boosting_learns_and_stops_early(spark, tmp_path):
    x, y, w, held = sample(400, 9)
    df = frame(spark, x, y, w, held)
    m = bo.SoftmaxBoosting(n_estimators=9, learning_rate=0.2, min_rows=2, patience=None, subsample=1.0).fit(df)
    fitted = [a for a, _ in m.losses]
    assert all(a > b for a, b in zip(fitted, fitted[1:])) and m.losses[-1][1] < 0.6 * m.losses[0][1]
    noise = df.withColumn("label", F.pmod(F.xxhash64("txn_id"), F.lit(3)).cast("int"))
    early = bo.SoftmaxBoosting(n_estimators=40, learning_rate=0.5, min_rows=2, patience=3).fit(noise)
    held_losses = [b for _, b in early.losses]
    assert len(held_losses) < 41 and early.n_rounds == int(np.argmin(held_losses))
    m.save(str(tmp_path / "m"))
    again = bo.SoftmaxModel.load(spark, str(tmp_path / "m"))
    from pyspark.ml.functions import vector_to_array
    p = lambda model: sorted((r[0], tuple(r[1])) for r in model.transform(df).select("txn_id", vector_to_array("probability")).collect())
    assert p(again) == p(m) and again.losses == m.losses


def test_boosting_weights_act(spark):
    x, y, _, held = sample(300, 4)
    y = np.where(np.random.default_rng(0).random(300) < 0.5, 0, y % 2)          # half of the labels say nothing
    heavy = np.where(y == 1, 20.0, 1.0)
    share = []
    for w in (np.ones(300), heavy):
        m = bo.SoftmaxBoosting(n_estimators=5, min_rows=2, patience=None).fit(frame(spark, x, y, w, held))
        from pyspark.ml.functions import vector_to_array
        share.append(m.transform(frame(spark, x, y, w, held)).agg(F.avg(vector_to_array("probability")[1])).first()[0])
    assert share[1] > share[0] + 0.2


def test_boosting_of_odd_inputs(spark):
    v = Vectors.dense([1.0, 0.0])
    one = spark.createDataFrame([(0, v)] * 5, ["label", "features"])
    m = bo.SoftmaxBoosting(n_estimators=2).fit(one)                # one class, nothing to split on
    assert m.transform(one).first()["probability"].toArray().tolist() == [1.0]
    with pytest.raises(ValueError):
        bo.SoftmaxBoosting().fit(one.limit(0))
    with pytest.raises(ValueError):
        bo.BoostingParams(max_depth=0)


# ----------------------------------------------------------------- attribution
def random_tree(rng, features, depth, classes=None):
    tree, value, stack, free = {}, {}, [(0, depth, 1000.0)], itertools.count(1)
    while stack:
        node, d, cover = stack.pop()
        if d == 0 or rng.random() < 0.2:
            tree[node] = (-1, 0.0, -1, -1, cover)
            value[node] = rng.normal(size=classes) if classes else rng.normal()
            continue
        left, right, part = next(free), next(free), rng.uniform(0.05, 0.95)
        tree[node] = (int(rng.integers(features)), float(rng.normal()), left, right, cover)
        stack += [(left, d - 1, cover * part), (right, d - 1, cover * (1 - part))]
    return tree, value


def expectation(tree, value, x, known, node=0):
    f, t, left, right, cover = tree[node]
    if f < 0:
        return value[node]
    if f in known:
        return expectation(tree, value, x, known, left if x[f] <= t else right)
    return sum(tree[k][4] / cover * expectation(tree, value, x, known, k) for k in (left, right))


def shapley(trees, x):
    """By enumeration of all subsets of features."""
    n = len(x)
    whole = lambda known: sum(expectation(t, v, x, known) for t, v in trees)
    out = np.zeros(n)
    for j in range(n):
        rest = [i for i in range(n) if i != j]
        for k in range(n):
            for s in itertools.combinations(rest, k):
                out[j] += math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n) * (whole({*s, j}) - whole(set(s)))
    return out, whole(set(range(n))), whole(set())


@pytest.mark.parametrize("seed", range(4))
def test_attribution_equals_enumeration(seed, monkeypatch):
    monkeypatch.setattr(at, "LEAVES", 5)
    rng = np.random.default_rng(seed)
    trees = [random_tree(rng, 6, 7) for _ in range(3)]             # features repeat along paths
    x = rng.normal(size=(9, 6))
    groups = at.pack([(tests, v[leaf], 2) for t, v in trees for tests, leaf in at.leaf_paths(t)])
    phi, score, expected = at.attribute(groups, x, np.full(9, 2))
    for i in range(9):
        want, full, empty = shapley(trees, x[i])
        assert np.allclose(phi[i], want) and np.isclose(score[i], full) and np.isclose(expected[i], empty)
    other, total, _ = at.attribute(groups, x, np.zeros(9, int))    # leaves of another class count nothing
    assert not other.any() and not total.any()


def test_attribution_with_a_value_per_class():
    rng = np.random.default_rng(7)
    tree, value = random_tree(rng, 4, 4, classes=3)
    x, cls = rng.normal(size=(5, 4)), np.array([0, 1, 2, 1, 0])
    phi, _, _ = at.attribute(at.pack([(t, value[leaf], -1) for t, leaf in at.leaf_paths(tree)]), x, cls)
    for i in range(5):
        assert np.allclose(phi[i], shapley([(tree, {k: v[cls[i]] for k, v in value.items()})], x[i])[0])


@pytest.fixture(scope="module")
def parts(spark, sf_small):
    led = nz.prepare_ledger(ledger_frame(spark, sf_small))
    lab = sp.label_split(led, sp.find_boundary(led, 0.8))
    return lab.filter(F.col("part") == "train"), lab.filter(F.col("part") == "val")


@pytest.mark.parametrize("kind, params", [("forest", dict(numTrees=4, maxDepth=4)), ("boosted", dict(n_estimators=3, max_depth=3))])
def test_explanation_of_fitted_trees(spark, parts, kind, params):
    """Additive for every row; scores, confidences and codes are the model's own; the top is sorted."""
    from ledgerlens.operators import explain as xp
    m = learn.train(parts[0], kind=kind, **params)
    val = parts[1].limit(80)
    width = len(m.features.feature_names())
    rows = xp.explain_fitted(m, val, ["txn_id"], n=6).collect()
    scored = {r["txn_id"]: r for r in m.score(val).collect()}
    assert len(rows) == 80
    groups = at.forest_leaves(spark, m.classifier) if kind == "forest" else at.boosted_leaves(m.classifier)
    from pyspark.ml.functions import vector_to_array
    x = {r["txn_id"]: np.array(r["x"]) for r in m.features.transform(val, keep=["txn_id"]).select(
        "txn_id", vector_to_array("features").alias("x")).collect()}
    for r in rows:
        s = scored[r["txn_id"]]
        assert r["total"] == pytest.approx(r["margin"], abs=1e-9)
        assert r["code"] == m.classes[s["y_pred"]] and r["confidence"] == pytest.approx(s["proba"][s["y_pred"]])
        phi, score, expected = at.attribute(groups, x[r["txn_id"]][None, :], np.array([s["y_pred"]]))
        if kind == "forest":
            assert score[0] == pytest.approx(r["confidence"])
        assert r["margin"] == pytest.approx(score[0] - expected[0], abs=1e-9)
        best = sorted(range(width), key=lambda j: (-abs(phi[0][j]), j))[:6]
        assert [t["contribution"] for t in r["top"]] == pytest.approx([phi[0][j] for j in best], abs=1e-9)
        assert [t["value"] for t in r["top"]][:1] == pytest.approx([x[r["txn_id"]][best[0]]])
    one = xp.explain_fitted(m, val, ["txn_id"], target_class=m.classes[1], n=2).collect()
    assert {r["code"] for r in one} == {m.classes[1]} and all(abs(r["total"] - r["margin"]) < 1e-9 for r in one)
    with pytest.raises(ValueError):
        xp.explain_fitted(m, val, ["txn_id"], target_class="no such code")
    imp = xp.fitted_importance(m, val, top=3).collect()
    assert len(imp) == 3 and imp[0]["importance"] >= imp[1]["importance"] > 0


# --------------------------------------------------------------------- pruning
def plain_survivors(rows, eta):
    fine = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    return sorted(t for t, a, e in fine[:math.ceil(len(rows) / eta)] if e is None)


def test_survivors_equal_plain_python(spark):
    rng = np.random.default_rng(2)
    for n, eta in ((9, 3), (10, 3), (7, 2), (1, 3)):
        rows = [(t, None if t % 4 == 3 else float(rng.integers(0, 4)) / 4, "failed" if t % 4 == 3 else None) for t in range(n)]
        df = spark.createDataFrame([(t, 0, a, e) for t, a, e in rows], "trial int, rung int, accuracy double, error string")
        assert sorted(r["trial"] for r in tuning.survivors(df, eta).collect()) == plain_survivors(rows, eta)


def test_successive_halving(spark):
    x, y, w, held = sample(400, 6)
    df = frame(spark, x, y, w, held).select("txn_id", "label", "features")
    grid = tuning.trial_grid(spark, 6).withColumn("max_depth", F.when(F.col("trial") == 4, -1).otherwise(F.col("max_depth")))
    trials, rungs = tuning.successive_halving(df.filter("txn_id < 300"), df.filter("txn_id >= 300"), grid, eta=2, rungs=3,
                                              n_estimators=2, min_child_weight=0.1, learning_rate=0.3)
    rungs, trials = rungs.collect(), {r["trial"]: r for r in trials.collect()}
    alive = set(range(6))
    for k in range(3):
        own = [r for r in rungs if r["rung"] == k]
        assert {r["trial"] for r in own} == alive and len({r["n_rows"] for r in own}) == 1
        alive = set(plain_survivors([(r["trial"], r["accuracy"], r["error"]) for r in own], 2))
    sizes = [next(r["n_rows"] for r in rungs if r["rung"] == k) for k in range(3)]
    assert sizes[0] < sizes[1] < sizes[2] == 300
    assert set(trials) == set(range(6)) and trials[4]["state"] == "FAILED" and "max_depth" in trials[4]["error"]
    last = {r["trial"] for r in rungs if r["rung"] == 2}
    assert {t for t, r in trials.items() if r["state"] == "COMPLETE"} == last
    assert {t for t, r in trials.items() if r["state"] == "PRUNED"} == set(range(6)) - last - {4}
    assert all(r["accuracy"] is not None and r["seconds"] > 0 for t, r in trials.items() if t != 4)
    nested = [{r[0] for r in tuning.nested_sample(df, s).select("txn_id").collect()} for s in (0.1, 0.4, 1.0)]
    assert nested[0] < nested[1] < nested[2] and len(nested[2]) == 400


def test_a_class_is_attributed_from_the_leaves_that_count_for_it():
    """Rows of each class see its leaves alone, and get what all leaves of the forest give."""
    rng = np.random.default_rng(3)
    tests = lambda: {int(f): (0.0, np.inf, float(s)) for f, s in zip(rng.choice(6, 3, False), rng.uniform(0.2, 0.8, 3))}
    values = np.eye(4)[rng.integers(0, 4, 40)] * rng.uniform(0.1, 1.0, (40, 1))
    paths = [(tests(), v, -1) for v in values]
    groups = at.pack(paths)
    x, cls = rng.normal(size=(30, 6)), rng.integers(0, 4, 30)
    for c in range(4):
        assert sum(len(g.feature) for g in at.for_class(groups, c)) == int((values[:, c] > 0).sum())
    phi, score, expected = at.attribute(groups, x, cls)
    for r in range(30):
        alone = [at.attribute(at.pack([p]), x[r][None, :], cls[r:r + 1]) for p in paths]
        assert np.allclose(phi[r], sum(a[0][0] for a in alone))
        assert np.isclose(score[r], sum(a[1][0] for a in alone)) and np.isclose(expected[r], sum(a[2][0] for a in alone))
        assert np.isclose(phi[r].sum(), score[r] - expected[r])
