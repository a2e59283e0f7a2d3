"""Evaluation against brute-force Python on the embeddings table."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import evaluate as ev
from ledgerlens.plans.learn import gate


@pytest.fixture(scope="module")
def pred(spark, sf_small):
    e = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    proba = ev.softmax(F.slice("embedding", 1, 10).cast("array<double>"))
    return e.select("vec_id", F.col("label").alias("y_true"), proba.alias("proba")) \
            .withColumn("y_pred", ev.argmax(F.col("proba")))


@pytest.fixture(scope="module")
def local(pred):
    rows = pred.orderBy("vec_id").collect()
    return (np.array([r["y_true"] for r in rows]), np.array([r["y_pred"] for r in rows]),
            np.array([r["proba"] for r in rows]))


def test_softmax_rows_sum_to_one(local):
    _, _, p = local
    assert np.allclose(p.sum(axis=1), 1.0)


def test_report_matches_python(pred, local):
    y, yh, _ = local
    labels = sorted(set(y) | set(yh))
    prec, rec, f1, sup = [], [], [], []
    for c in labels:
        tp = np.sum((y == c) & (yh == c)); pc = np.sum(yh == c); s = np.sum(y == c)
        p = tp / pc if pc else 0.0; r = tp / s if s else 0.0
        prec.append(p); rec.append(r); f1.append(2 * p * r / (p + r) if p + r else 0.0); sup.append(s)
    sup = np.array(sup)
    got = ev.classification_report(pred).first()
    assert math.isclose(got["accuracy"], np.mean(y == yh))
    assert math.isclose(got["balanced_accuracy"], np.mean([r for r, s in zip(rec, sup) if s > 0]))
    assert math.isclose(got["f1_macro"], np.mean(f1))
    assert math.isclose(got["f1_weighted"], np.sum(np.array(f1) * sup) / sup.sum())


def test_topk_and_histogram(pred, local):
    y, _, p = local
    order = np.argsort(-p, axis=1)
    got = {r["k"]: r["accuracy"] for r in ev.topk_accuracy(pred, 10).collect()}
    for k in (1, 3, 5, 10):
        assert math.isclose(got[k], np.mean(np.any(order[:, :k] == y[:, None], axis=1)))
    conf = pred.select(F.array_max("proba").alias("confidence"))
    hist = [r["n"] for r in ev.confidence_histogram(conf).orderBy("bin").collect()]
    counts, _ = np.histogram(p.max(axis=1), bins=np.linspace(0, 1, 11))
    assert hist == list(counts) and sum(hist) == len(y)
    assert math.isclose(ev.exact_median(conf, "confidence"), float(np.median(p.max(axis=1))))


def test_exact_median_refinement(spark):
    df = spark.range(1009).select((F.col("id") * 7 % 1009).cast("double").alias("v"))
    st = df.agg(F.min("v"), F.max("v")).first()
    assert ev.kth_value(df, "v", 500, 1009, st[0], st[1], leaf_rows=10) == 499.0


def test_calibration_excludes_one(spark):
    df = spark.createDataFrame([([1.0, 0.0], 0), ([0.3, 0.7], 1)], "proba array<double>, y_true int")
    rows = {r["bin"]: r for r in ev.calibration(df).collect()}
    # conf 1.0 is in no bin; 0.7 is in bin 6 because edge 7 is 7 * 0.1 = 0.7000000000000001
    assert sum(r["n"] for r in rows.values()) == 1 and rows[6]["n"] == 1
    assert rows[0]["mean_confidence"] == pytest.approx(0.05)


def test_gate_inclusive():
    assert gate({"accuracy": 0.48, "balanced_accuracy": 0.24}, 0.40, 5)["passed"]
    assert not gate({"accuracy": 0.47, "balanced_accuracy": 0.24}, 0.40, 5)["passed"]
    assert not gate({}, 0.40, 5)["passed"]
