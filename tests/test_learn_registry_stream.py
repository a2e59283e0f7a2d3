"""Learning invariants, registry round trip, stream = batch."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import normalize as nz
from ledgerlens.operators import split as sp
from ledgerlens.operators.registry import ModelRegistry, load_bundle, save_bundle
from ledgerlens.plans import learn, tuning
from ledgerlens.sources.ledger import ledger_frame
from ledgerlens.streaming import monitor as sm


@pytest.fixture(scope="module")
def parts(spark, sf_small):
    led = nz.prepare_ledger(ledger_frame(spark, sf_small))
    lab = sp.label_split(led, sp.find_boundary(led, 0.8))
    return lab.filter(F.col("part") == "train"), lab.filter(F.col("part") == "val")


@pytest.fixture(scope="module")
def model(parts):
    return learn.train(parts[0], kind="forest", numTrees=5, maxDepth=4)


def test_scores_are_distributions(model, parts):
    rows = model.score(parts[1]).collect()
    p = np.array([r["proba"] for r in rows])
    assert p.shape[1] == len(model.classes) and np.allclose(p.sum(axis=1), 1.0)


def test_classify_sorted_k(model, parts):
    for r in model.classify(parts[1], k=3).collect():
        conf = [x["confidence"] for x in r["predictions"]]
        assert len(conf) == 3 and conf == sorted(conf, reverse=True)
        assert all(x["code"] in model.classes for x in r["predictions"])


def test_feature_width_same_in_fit_and_transform(model, parts):
    from pyspark.ml.functions import vector_to_array
    w_tr = {r[0] for r in model.features.transform(parts[0], keep=["txn_id"])
            .select(F.size(vector_to_array("features"))).distinct().collect()}
    w_va = {r[0] for r in model.features.transform(parts[1], keep=["txn_id"])
            .select(F.size(vector_to_array("features"))).distinct().collect()}
    assert w_tr == w_va and len(w_tr) == 1
    assert len(model.features.feature_names()) == w_tr.pop()


def test_tfidf_vector_matches_long_form(model, parts):
    """The batch-built sparse vector equals the long-form TF-IDF weights."""
    from pyspark.ml.functions import vector_to_array
    from ledgerlens.operators.tfidf import ledger_texts
    tfm = model.features.tfidf
    long = tfm.transform(ledger_texts(parts[1])).collect()
    rel = {(r["doc_id"], r["col_index"]): r["weight"]
           for r in tfm.transform_relational(ledger_texts(parts[1])).collect()}
    assert set(rel) == {(r["doc_id"], r["col_index"]) for r in long}
    assert all(abs(rel[(r["doc_id"], r["col_index"])] - r["weight"]) < 1e-12 for r in long)
    expect = {(r["doc_id"], r["col_index"]): r["weight"] for r in long}
    vec = model.features.transform(parts[1], keep=["txn_id"]).select(
        "txn_id", vector_to_array("features").alias("a")).collect()
    for r in vec:
        for j in range(tfm.width):
            assert r["a"][j] == pytest.approx(expect.get((r["txn_id"], j), 0.0), abs=1e-9)


def test_registry_round_trip(spark, model, tmp_path):
    reg = ModelRegistry(spark, str(tmp_path / "reg"))
    man = save_bundle(reg, model, {"accuracy": 0.5}, {"kind": "forest"}, version="v-1")
    save_bundle(reg, model, {"accuracy": 0.6}, {"kind": "forest"}, version="v-2")
    assert [r["version"] for r in reg.versions().collect()] == ["v-2", "v-1"]
    with pytest.raises(FileNotFoundError):
        reg.promote("v-9")
    reg.promote("v-1")
    assert reg.active() == "v-1"
    reg.mark_loaded("v-1")
    assert not reg.has_update()
    reg.promote("v-2")
    assert reg.active() == "v-2" and reg.has_update()
    reg.verify("v-1")
    victim = next(f for f in man["checksums"] if f.startswith("meta/part"))
    (tmp_path / "reg" / "versions" / "v-1" / victim).write_text("tampered")
    with pytest.raises(RuntimeError, match="altered: .*meta/part|cannot be read back"):
        reg.verify("v-1")
    with pytest.raises(RuntimeError):
        load_bundle(reg, "v-1")


@pytest.mark.parametrize("kind, params", [("forest", {"numTrees": 5, "maxDepth": 4}), ("logistic", {"maxIter": 10})])
def test_loaded_bundle_scores_alike(spark, parts, tmp_path, kind, params):
    m = learn.train(parts[0], kind=kind, **params)
    reg = ModelRegistry(spark, str(tmp_path / "reg"))
    with pytest.raises(FileNotFoundError):
        load_bundle(reg)
    reg.promote(save_bundle(reg, m, {"accuracy": 0.5, "none": None}, {"kind": kind})["version"])
    again = load_bundle(reg)
    assert again.classes == m.classes and again.metrics == {"accuracy": 0.5} and not reg.has_update()
    assert again.features.tfidf.n_docs == m.features.tfidf.n_docs
    a = {r["txn_id"]: (r["y_pred"], r["proba"]) for r in m.score(parts[1]).collect()}
    b = {r["txn_id"]: (r["y_pred"], r["proba"]) for r in again.score(parts[1]).collect()}
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and np.allclose(a[k][1], b[k][1]) for k in a)


def test_explanation_of_fitted_model(spark, parts):
    from pyspark.ml.functions import vector_to_array
    from ledgerlens.operators import explain as xp
    m = learn.train(parts[0], kind="logistic", maxIter=15)
    val = parts[1].limit(60)
    rows = xp.explain_fitted(m, val, ["txn_id"], n=3).collect()
    x = {r["txn_id"]: np.array(r["x"]) for r in m.features.transform(val, keep=["txn_id"]).select(
        "txn_id", vector_to_array("features").alias("x")).collect()}
    w, names = m.classifier.coefficientMatrix.toArray(), m.features.feature_names()
    for r in rows:
        c = w[m.classes.index(r["code"])] * (x[r["txn_id"]] - m.means)
        assert r["total"] == pytest.approx(c.sum()) and r["margin"] == pytest.approx(c.sum())
        best = sorted(range(len(c)), key=lambda j: (-abs(c[j]), j))[:3]
        assert [t["contribution"] for t in r["top"]] == pytest.approx([c[j] for j in best])
        assert [t["feature"] for t in r["top"]] == [names[j] for j in best]
    chosen = xp.explain_fitted(m, val, ["txn_id"], target_class=m.classes[1], n=2).collect()
    assert {r["code"] for r in chosen} == {m.classes[1]}
    with pytest.raises(ValueError):
        xp.explain_fitted(m, val, ["txn_id"], target_class="no such code")
    dense = np.stack(list(x.values()))
    want = np.abs(w).mean(0) * np.abs(dense - m.means).mean(0)
    got = {r["feature"]: r["importance"] for r in xp.fitted_importance(m, val, top=5).collect()}
    best = sorted(range(len(want)), key=lambda j: -want[j])[:5]
    assert sorted(got.values()) == pytest.approx(sorted(want[best]))


def test_boosted_classes(spark):
    from pyspark.ml.linalg import Vectors
    rows = [(float(i % 3), Vectors.dense([i % 3 == 1, i % 3 == 2, i % 7])) for i in range(240)]
    x = spark.createDataFrame(rows, ["label", "features"])
    m = learn.make_classifier("boosted", n_estimators=4, max_depth=2, min_rows=2, patience=None).fit(x)
    from pyspark.ml.functions import vector_to_array
    out = m.transform(x).select("label", vector_to_array("probability").alias("p")).collect()
    assert all(len(r["p"]) == 3 and abs(sum(r["p"]) - 1) < 1e-9 for r in out)
    assert all(int(np.argmax(r["p"])) == int(r["label"]) for r in out)


def test_training_refuses_bad_ledgers(parts):
    with pytest.raises(ValueError):
        learn.train(parts[0].limit(0))
    with pytest.raises(ValueError):
        learn.train(parts[0].withColumn("debit", F.lit(0.0)).withColumn("credit", F.lit(0.0)))


def test_failed_trials_keep_their_error(spark, parts):
    from pyspark.ml.linalg import Vectors
    x = spark.createDataFrame([(0.0, Vectors.dense([1.0])), (1.0, Vectors.dense([0.0]))], ["label", "features"])
    grid = tuning.trial_grid(spark, 2).withColumn("max_depth", F.lit(-1))
    columns = list(grid.columns)
    with pytest.raises(RuntimeError, match="no trial completed"):
        tuning.tune(x, x, grid)
    assert grid.columns == columns


def test_trial_grid_baseline_first(spark):
    g = tuning.trial_grid(spark, 5).orderBy("trial").collect()
    assert g[0]["n_estimators"] == 500 and g[0]["max_bin"] == 256
    for r in g[1:]:
        assert 200 <= r["n_estimators"] <= 1500 and (r["n_estimators"] - 200) % 50 == 0
        assert 0.005 <= r["learning_rate"] <= 0.3 and (r["max_bin"] - 128) % 64 == 0
    assert g == tuning.trial_grid(spark, 5).orderBy("trial").collect()  # repeatable


def test_promotions_at_once_have_one_order(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    reg = ModelRegistry(spark, str(tmp_path / "reg"))
    names = [f"v-{i}" for i in range(12)]
    for v in names:
        (tmp_path / "reg" / "versions" / v).mkdir(parents=True)
        (tmp_path / "reg" / "versions" / v / "file").write_text(v)
        reg.register(v, {}, {}, 1, 1)
    import datetime as dt
    now = dt.datetime(2024, 5, 1)
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda v: ModelRegistry(spark, reg.root).promote(v, now), names))
    assert sorted(numbers) == list(range(1, 13))                   # each promotion has a number of its own
    order = {r["n"]: r["version"] for r in reg.promotions().collect()}
    assert order == dict(zip(numbers, names))
    assert {ModelRegistry(spark, reg.root).active() for _ in range(3)} == {order[12]}
    (tmp_path / "reg" / "promotions" / "000000000013.json").write_text("")        # claimed, not written yet
    assert reg.active() == order[12] and reg.promote("v-0") == 14 and reg.active() == "v-0"


# ------------------------------------------------------------------- streaming
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_stream_windows_close_behind_the_watermark(spark, sf_small):
    import datetime as dt
    events = spark.read.parquet(f"{sf_small}/events.parquet")
    table = sm.StreamTable(spark, "test")
    for folder in sm.feed(events, "events-test", by="ts"):
        stream = sm.class_counts_windows(sm.event_stream(spark, folder))
        table.advance(stream)
    got = {(r["w"]["start"], r["cls"], r["n"]) for r in table.read(stream.schema).collect()}
    ts = F.col("ts").cast("timestamp")
    last = events.agg(F.max(ts)).first()[0]
    batch = events.groupBy(F.window(ts, "1 day").alias("w"), F.col("event_type").alias("cls")).count()
    want = {(r["w"]["start"], r["cls"], r["count"]) for r in batch.collect() if r["w"]["end"] <= last - dt.timedelta(days=1)}
    assert got == want and got


def test_stream_queries_count_every_event(spark, sf_small, tmp_path):
    """Both stream queries against SQL over all events, with a last day and a row without a time."""
    import duckdb

    import __spark_entry__ as E
    events = spark.read.parquet(f"{sf_small}/events.parquet")
    timeless = events.limit(1).withColumn("ts", F.lit(None).cast(events.schema["ts"].dataType))
    events.union(timeless).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("stream_class_counts", "stream_confidence"):
        df = E.queries()[name](spark, str(tmp_path))
        got = sorted((tuple(r) for r in df.collect()), key=repr)
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({E.oracle_sql()[name]})").fetchall()
        assert got == sorted(want, key=repr) and sum(r[2] for r in got) == events.count()
    whole = [f for f in sm.feed(events.union(timeless), "timeless", by="ts")][-1]
    assert spark.read.parquet(whole).count() == events.count() + 1


def test_late_events_correct_their_window(spark):
    """An event far behind the watermark changes its window's total; a batch that runs again changes nothing."""
    import datetime as dt
    day = lambda d, h=0: dt.datetime(2024, 3, d, h)
    rows = lambda *x: spark.createDataFrame([(i, t, 0, k, 1.0, "") for i, (t, k) in enumerate(x)], EVENTS)
    table = sm.WindowTable(spark, "late", sm.day_counts(F.col("event_type")), "w timestamp, key string, n long")
    state = lambda t=table: {(r["w"], r["key"]): r["n"] for r in t.read().collect()}
    assert state() == {}
    batches = [rows((day(1), "a"), (day(1, 5), "a"), (day(2), "b"), (None, "a")), rows((day(20), "a")),
               rows((day(1, 7), "a"), (day(1), None), (day(2), "a"))]
    for i, b in enumerate(batches):
        table.upsert(b, i)
    want = {(day(1), "a"): 3, (day(1), None): 1, (day(2), "b"): 1, (day(2), "a"): 1, (day(20), "a"): 1}
    assert state() == want
    table.upsert(batches[2], 2)                                    # the last batch again, after a failure
    assert state() == want
    small = table.compact()
    assert state(small) == want and state() == want
    small.upsert(rows((day(1), "a")), 3)
    assert state(small) == {**want, (day(1), "a"): 4}
    table.upsert(rows(), 3)                                        # an empty batch
    assert state() == want


def test_upserts_from_a_stream_resume(spark, sf_small):
    events = spark.read.parquet(f"{sf_small}/events.parquet")
    backwards = events.withColumn("late", -F.col("event_id"))      # the newest events come first
    table = sm.WindowTable(spark, "back", sm.day_counts(F.col("event_type")), "w timestamp, key string, n long")
    for folder in sm.feed(backwards, "backwards", by="late", steps=3):
        table.advance(sm.event_stream(spark, folder))
    ts = F.col("ts").cast("timestamp")
    want = {(r["w"]["start"], r["event_type"], r["count"]) for r in events.groupBy(F.window(ts, "1 day").alias("w"), "event_type").count().collect()}
    assert {(r["w"], r["key"], r["n"]) for r in table.read().collect()} == want


def test_stream_drift_equals_batch(spark, sf_small):
    from ledgerlens.plans import catalog_learn as cl
    from ledgerlens.plans import catalog_more as cm
    got = cl.q_stream_drift(spark, sf_small).orderBy("w").collect()
    assert got == cm.q_confidence_drift(spark, sf_small).orderBy("w").collect() and len(got) > 5
    assert got[0]["l1_drift"] is None and got[1]["l1_drift"] is not None


def test_stream_drift_state_expires(spark):
    """After a pause longer than the state is kept for, the next window starts anew."""
    import datetime as dt
    at = [dt.datetime(2024, 1, d, 3) for d in (1, 2)] + [dt.datetime(2024, 6, d, 3) for d in (1, 2, 3)] + [dt.datetime(2024, 9, 1)]
    table = sm.StreamTable(spark, "pause")
    with sm.rocksdb_state(spark):
        df = spark.createDataFrame([(i, t, 0, "e", 100.0 * i, "") for i, t in enumerate(at)], EVENTS)
        for folder in sm.feed(df, "pause", by="ts", steps=6, closing=True):
            stream = sm.drift_stream(sm.event_stream(spark, folder), F.least(F.col("value") / 500.0, F.lit(1.0)), keep_days=60)
            table.advance(stream)
    got = [(r["w"].month, r["w"].day, r["l1_drift"] is None) for r in table.read(stream.schema).orderBy("w").collect()]
    assert got == [(1, 1, True), (1, 2, False), (6, 1, True), (6, 2, False), (6, 3, False), (9, 1, True)]


# --------------------------------------------------- what the model queries say
def test_model_queries_give_what_the_model_says(spark, sf_small):
    """Codes, confidences, metrics and ranks recomputed from the probabilities, on the smallest tables."""
    import __spark_entry__ as E
    from ledgerlens.plans import catalog_learn as cl
    q = E.queries()
    run = lambda name: [r.asDict() for r in q[name](spark, sf_small).collect()]
    m = cl.fitted(spark, sf_small)
    _, va = cl._split(spark, sf_small)
    proba = {r["txn_id"]: np.array(r["proba"]) for r in m.score(va).collect()}
    truth = {r["txn_id"]: r["target"] for r in va.select("txn_id", "target").collect()}
    known = {t: c for t, c in truth.items() if c in m.classes}
    best = {t: m.classes[int(p.argmax())] for t, p in proba.items()}

    for name in ("classify", "stream_score"):
        got = run(name)
        assert len(got) == 3 * len(proba)
        for r in got:
            order = sorted(range(len(m.classes)), key=lambda c: (-proba[r["txn_id"]][c], c))
            assert r["code"] == m.classes[order[r["rank"] - 1]]
            assert r["confidence"] == pytest.approx(proba[r["txn_id"]][order[r["rank"] - 1]], abs=6e-5)
    got = {r["txn_id"]: r for r in run("train_score")}
    assert set(got) == set(known)
    for t, r in got.items():
        assert (r["target"], r["code"], r["hit"]) == (known[t], best[t], int(best[t] == known[t]))
        assert r["true_confidence"] == pytest.approx(proba[t][m.classes.index(known[t])], abs=1e-6)
    accuracy = np.mean([best[t] == c for t, c in known.items()])
    balanced = np.mean([np.mean([best[t] == c for t, k in known.items() if k == c]) for c in set(known.values())])
    row = run("train_pipeline")[0]
    assert row["accuracy"] == pytest.approx(accuracy) and row["balanced_accuracy"] == pytest.approx(balanced)
    assert row["passed"] == int(accuracy >= row["acc_threshold"] and balanced >= row["bal_threshold"]) and row["train_seconds"] > 0
    for r in run("evaluate_model"):
        hits = [(proba[t] > proba[t][m.classes.index(c)]).sum() < r["k"] for t, c in known.items()]
        assert r["accuracy"] == pytest.approx(np.mean(hits)) and r["n_rows"] == len(known)
    pairs = {(r["target"], r["code"]): r["n"] for r in run("model_confusion_pairs")}
    assert sum(pairs.values()) == len(known) and all(n == sum(best[t] == p and c == k for t, c in known.items()) for (k, p), n in pairs.items())
    for r in run("model_per_class"):
        assert r["support"] == sum(c == r["code"] for c in known.values())
        if r["support"]:
            assert r["recall"] == pytest.approx(pairs.get((r["code"], r["code"]), 0) / r["support"])
    for r in run("model_calibration"):
        mine = [t for t in known if r["bin"] / 10 <= proba[t].max() < (r["bin"] + 1) / 10]
        assert abs(r["n"] - len(mine)) <= 1
        if mine and r["n"] == len(mine):
            assert r["accuracy"] == pytest.approx(np.mean([best[t] == known[t] for t in mine]))
    versions = run("registry_versions")
    assert len(versions) == 2 and [r["active"] for r in versions] == [True, False]
    assert all(r["accuracy"] == pytest.approx(accuracy) and r["promotions"] == 1 and r["n_files"] > 5 for r in versions)
    assert {r["same"] for r in run("registry_round_trip")} == {1}
    explained = run("explain_model")
    assert len(explained) == 5 * len(proba) and {r["rank"] for r in explained} == {1, 2, 3, 4, 5}
    assert all(r["code"] == best[r["txn_id"]] and r["confidence"] == pytest.approx(proba[r["txn_id"]].max(), abs=6e-5) for r in explained)
    assert {r["adds_up"] for r in run("explain_model_facts")} == {1}
    importance = run("model_importance")
    assert len(importance) == 20 and importance[0]["importance"] >= importance[-1]["importance"] > 0
