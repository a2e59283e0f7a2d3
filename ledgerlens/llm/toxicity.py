"""Toxicity (operator 3): FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashes (2**20 buckets) of single words, neighbouring pairs and pairs with one word
between, over the lower-cased runs of letters and digits of the whole text; no label, language, source or id.
FTRL-proximal keeps a learning rate per coordinate, and its L1 term leaves most weights at exactly zero, so
the model is a short sorted list of (bucket, weight) that is sent to every task.  Scoring is one pass over
the texts where they lie: no shuffle.

The fit uses about ``limit`` labelled documents at most (a documented parameter), chosen by hash among those
that are not held out, in hash order, ``epochs`` times over; their features are computed where the texts are
read and one task runs the sequential updates.  Reruns agree.

Null or empty text: the score of a text without features (the learned bias).  Without any usable label every
score is 0.  Repeated rows get equal scores.  Very long texts are scored whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm import words as wd
from ledgerlens.llm.common import held_out, table, written
from ledgerlens.llm.learn import labelled_sample

BITS = 20
LIMIT = 12_000
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every feature occurrence, row it belongs to)."""
    body, at = wd.raw_bytes(column)
    starts, ends, first = wd.word_spans(body, at, _ALNUM)
    h = wd.hash_spans(body, starts, ends, lower=True)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    out, rows = [h], [row]
    for gap, salt in ((1, 0x51ED270B), (2, 0xA24BAED4)):
        if len(h) > gap:
            same = row[:-gap] == row[gap:]
            pair = wd.mix64(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(salt))
            out.append(pair[same])
            rows.append(row[:-gap][same])
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rows)


def fit_ftrl(examples, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """Weights and bias from [(distinct buckets, label)]; the bias has no L1."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    for _ in range(epochs):
        for idx, y in examples:
            zi, ni = z[idx], n[idx]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            wb = -zb / ((beta + math.sqrt(nb)) / alpha + l2)
            p = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, wb + float(w.sum())))))
            g = p - y
            n[idx] = ni + g * g
            z[idx] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * w
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * wb
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, -zb / ((beta + math.sqrt(nb)) / alpha + l2)


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", limit: int = LIMIT, epochs: int = 6,
          alpha: float = 2.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.0) -> dict | None:
    """{"at": sorted buckets, "w": their weights, "bias"}, or None without usable labels."""
    def collect_features(it):
        for b in wd.bounded(it):
            f, row = features(b["text"])
            key = np.unique(row.astype(np.int64) << BITS | f)
            cut = np.searchsorted(key >> BITS, np.arange(b.num_rows + 1))
            flat = (key & ((1 << BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b["turn"], b["label"], pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(flat))],
                names=["turn", "label", "at"])

    sample = labelled_sample(docs, labels, target, limit).select(
        F.xxhash64("doc_id", F.lit(7)).alias("turn"), "text", "label")
    rows = written(sample.mapInArrow(collect_features, "turn long, label int, at array<int>"), "tox-sample")

    def fit(it):
        examples = []
        for b in it:
            col = b["at"]
            flat, cut = col.values.to_numpy(), col.offsets.to_numpy()
            examples += [(flat[cut[i]:cut[i + 1]], y) for i, y in enumerate(b["label"].to_pylist())]
        if examples:
            w, bias = fit_ftrl(examples, epochs, alpha, beta, l1, l2)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w[at], bias), pa.float64())], names=["at", "w"])
    got = rows.repartition(1).sortWithinPartitions("turn").mapInArrow(fit, "at long, w double").collect()
    if not got:
        return None
    bias = next(r.w for r in got if r["at"] < 0)
    kept = sorted((r["at"], r.w) for r in got if r["at"] >= 0)
    return {"at": np.array([a for a, _ in kept], np.int64), "w": np.array([w for _, w in kept]), "bias": bias}


def score(docs: DataFrame, model: dict | None, out: str = "score") -> DataFrame:
    """``docs`` with the toxicity of ``text`` (0 to 1) appended (in place of a column of that name)."""
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(it):
        m = shared.value
        dense = np.zeros(1 << BITS)
        dense[m["at"]] = m["w"]
        for b in wd.bounded(it):
            f, row = features(b["text"])
            w = dense[f]
            hit = np.flatnonzero(w)                             # few: only these need to be made distinct
            key = np.unique(row[hit].astype(np.int64) << BITS | f[hit])
            s = np.bincount(key >> BITS, dense[key & ((1 << BITS) - 1)], b.num_rows) + m["bias"]
            p = 1.0 / (1.0 + np.exp(-np.clip(s, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, out])
    return docs.mapInArrow(run, schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))
