"""Quality classifier (operator 5): random-indexing word vectors pooled per document, then a two-layer numpy
network with temperature-calibrated probabilities.

Random indexing: every unit has a fixed sparse ternary index vector, and its context vector is the sum of
the index vectors of the units up to two words away, over all texts of the table.  The units of a word are
its hash bucket (2**14) and its shape (letter case, punctuation, last character, length, and whether it
repeats one of the two words before it), which stays informative for words never seen before.  The sums are
integers, so they do not depend on the order of tasks; each task sends one vector of fixed size, and the
vectors are summed as a stream.

A document is the mean of its word vectors joined to the mean of its shape vectors.  The network (one hidden
layer of ReLU units, Adam) learns from the pooled vectors of about ``limit`` labelled documents at most (a
documented parameter), chosen by hash among those not held out; a fifth of them only sets the temperature
that calibrates the probabilities.  No label, language, source or id is an input.  Scoring reads each text
once where it lies: no shuffle.  Reruns agree.

Null, empty or blank text: the score of a zero vector.  Without labels of both kinds every score is the
share of label 1, or 0.5 without any.  Repeated rows get equal scores.  Texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm import words as wd
from ledgerlens.llm.common import held_out, table, written
from ledgerlens.llm.learn import labelled_sample, sum_vectors, vector_rows

WORDS, SHAPES, DIM = 1 << 14, 1024, 32
UNITS = WORDS + SHAPES
LIMIT = 8_000
PARTS = 16
STEP = 200_000                      # words handled at a time
GRAIN = 1 << 20
_FIELD = np.zeros(256, np.uint64)   # per byte one count in a 12-bit field: capital, small, other letter, digit, punctuation
_FIELD[:] = np.uint64(1) << np.uint64(48)
_FIELD[65:91] = 1
_FIELD[97:123] = np.uint64(1) << np.uint64(12)
_FIELD[128:] = np.uint64(1) << np.uint64(24)
_FIELD[48:58] = np.uint64(1) << np.uint64(36)
_LAST = np.full(256, 4, np.int64)
_LAST[48:58] = _LAST[65:91] = _LAST[97:123] = _LAST[128:] = 0
_LAST[[ord(c) for c in ".,;:?'\"()"]] = 1
_LAST[ord("!")] = 2
_LAST[ord("|")] = 3


def index_vectors(seed: int = 11, ones: int = 4) -> np.ndarray:
    """Fixed ternary vectors (rows: units, plus one zero row) with ``ones`` entries of +1 or -1."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((UNITS + 1, DIM), np.float32)
    for _ in range(ones):
        out[np.arange(UNITS), rng.integers(0, DIM, UNITS)] = rng.choice([-1.0, 1.0], UNITS)
    return out


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, shape unit, first word of each row) of all words of a column."""
    body, at = wd.raw_bytes(column)
    starts, ends, first = wd.word_spans(body, at)
    h = wd.hash_spans(body, starts, ends, lower=False)
    n = len(h)
    counts = np.empty(n, np.uint64)
    a = 0
    while a < n:                                       # sums of the fields, a bounded piece at a time
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + wd.CHUNK, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_FIELD[body[lo:hi]], out=total[1:])
        counts[a:b] = total[ends[a:b] - lo] - total[starts[a:b] - lo]
        a = b
    field = lambda k: (counts >> np.uint64(12 * k)).astype(np.int64) & 4095
    capital, small, other, punct = field(0), field(1), field(2), field(4)
    case = np.where(capital + small + other == 0, 0, np.where(capital == 0, 1, np.where((capital > 1) & (small == 0), 3, 2)))
    length = np.searchsorted([3, 6, 10, 16], ends - starts, "right")
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    again = np.zeros(n, np.int64)
    for gap in (1, 2):
        again[gap:] |= (h[gap:] == h[:-gap]) & (row[gap:] == row[:-gap])
    shape = (((case * 4 + np.minimum(punct, 3)) * 5 + (_LAST[body[ends - 1]] if n else 0)) * 5 + length) * 2 + again
    return (h >> np.uint64(64 - 14)).astype(np.int64), WORDS + shape, first


def add_contexts(total: np.ndarray, index: np.ndarray, word: np.ndarray, shape: np.ndarray, first: np.ndarray) -> None:
    """Add the context of every word of the batch to the rows of its two units (context: two words either
    side, not beyond the text)."""
    n = np.diff(first)
    spread = np.arange(len(word)) + 2 * np.repeat(np.arange(len(n)), n) + 2     # two empty places between texts
    wide_w = np.full(len(word) + 2 * len(n) + 4, UNITS, np.int64)
    wide_s = wide_w.copy()
    wide_w[spread], wide_s[spread] = word, shape
    for a in range(2, len(wide_w) - 2, STEP):
        b = min(len(wide_w) - 2, a + STEP)
        own = index[wide_w[a - 2:b + 2]] + index[wide_s[a - 2:b + 2]]
        near = own[:-4] + own[1:-3] + own[3:-1] + own[4:]
        for unit in (wide_w[a:b], wide_s[a:b]):
            order = np.argsort(unit.astype(np.uint16), kind="stable")
            key = unit[order]
            cut = np.flatnonzero(np.diff(key, prepend=-1))
            total[key[cut]] += np.add.reduceat(near[order], cut, axis=0)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors of all units, from every text of ``docs``: of unit length, in multiples of 1 / GRAIN."""
    def count(it):
        index = index_vectors()
        total = np.zeros((UNITS + 1, DIM), np.float64)
        for b in wd.bounded(it):
            add_contexts(total, index, *units(b["text"]))
        yield vector_rows(total[:UNITS], PARTS)
    flat = sum_vectors(docs.select("text").mapInArrow(count, "part int, data binary"), PARTS, "quality-contexts")
    v = flat.reshape(UNITS, DIM).astype(np.float64) if len(flat) else np.zeros((UNITS, DIM))
    used = np.abs(v).sum(1) > 0
    v[used] /= np.linalg.norm(v[used], axis=1, keepdims=True)
    if used.any():
        v[used] -= v[used].mean(0)                      # what all units share says nothing
        v[used] /= np.maximum(np.linalg.norm(v[used], axis=1, keepdims=True), 1e-12)
    return np.rint(v * GRAIN).astype(np.int32)


def pool(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """(rows, 2 * DIM) means of word and shape vectors; zero for a text without words.  The vectors are whole
    multiples of 1 / GRAIN and are summed as integers, so equal texts have equal means wherever they stand."""
    word, shape, first = units(column)
    total = np.zeros((len(column), 2 * DIM), np.int64)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    for a in range(0, len(word), STEP):
        b = min(len(word), a + STEP)
        cut = np.flatnonzero(np.diff(row[a:b], prepend=-1))
        at = row[a:b][cut]
        total[at, :DIM] += np.add.reduceat(vectors[word[a:b]], cut, axis=0, dtype=np.int64)
        total[at, DIM:] += np.add.reduceat(vectors[shape[a:b]], cut, axis=0, dtype=np.int64)
    return total / (np.maximum(n, 1)[:, None] * float(GRAIN))


def _forward(net: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum((x - net["mean"]) / net["scale"] @ net["w1"] + net["b1"], 0.0)
    return hidden, hidden @ net["w2"] + net["b2"]


def probability(net: dict, x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(_forward(net, x)[1] / net["temperature"], -35, 35)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 80, batch: int = 64,
                rate: float = 0.005, decay: float = 1e-4, seed: int = 3) -> dict:
    """Two layers by Adam on four fifths of the rows; the temperature by likelihood on the rest."""
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(x))
    rest = order[: len(x) // 5]
    fit = order[len(rest):]
    net = {"mean": x[fit].mean(0), "scale": x[fit].std(0) + 1e-6, "temperature": 1.0,
           "w1": rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), "b1": np.zeros(hidden),
           "w2": rng.normal(0, np.sqrt(1 / hidden), hidden), "b2": 0.0}
    names = ("w1", "b1", "w2", "b2")
    m1 = {k: np.zeros_like(net[k]) for k in names}
    m2 = {k: np.zeros_like(net[k]) for k in names}
    step = 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for a in range(0, len(fit), batch):
            at = fit[a:a + batch]
            h, s = _forward(net, x[at])
            d = (1 / (1 + np.exp(-np.clip(s, -35, 35))) - y[at]) / len(at)
            back = np.outer(d, net["w2"]) * (h > 0)
            z = (x[at] - net["mean"]) / net["scale"]
            grad = {"w1": z.T @ back + decay * net["w1"], "b1": back.sum(0), "w2": h.T @ d + decay * net["w2"], "b2": d.sum()}
            step += 1
            for k in names:
                m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                m2[k] = 0.999 * m2[k] + 0.001 * grad[k] ** 2
                net[k] = net[k] - rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    if len(rest) >= 20:
        s, t = _forward(net, x[rest])[1], y[rest]
        loss = lambda c: np.logaddexp(0, np.where(t == 1, -s, s) / c).mean()
        net["temperature"] = float(min(np.geomspace(0.02, 50, 160), key=loss))
    return net


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", limit: int = LIMIT) -> dict:
    """{"vectors", "net"} or {"constant"} without labels of both kinds."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pooled(it):
        for b in wd.bounded(it):
            x = pool(b["text"], shared.value)
            yield pa.RecordBatch.from_arrays([b["turn"], b["label"], pa.array(list(x), pa.list_(pa.float64()))],
                                             names=["turn", "label", "x"])
    sample = labelled_sample(docs, labels, target, limit).select(F.xxhash64("doc_id", F.lit(7)).alias("turn"), "text", "label")
    got = written(sample.mapInArrow(pooled, "turn long, label int, x array<double>"), "quality-sample").toPandas()
    got = got.sort_values("turn", kind="stable")
    y = got.label.to_numpy(float)
    if len(set(y)) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.5}
    return {"vectors": vectors, "net": fit_network(np.stack(got.x.to_list()), y)}


def score(docs: DataFrame, model: dict, out: str = "score") -> DataFrame:
    """``docs`` with the calibrated probability of label 1 appended (in place of a column of that name)."""
    if "constant" in model:
        return docs.withColumn(out, F.lit(model["constant"]))
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def run(it):
        m = shared.value
        for b in wd.bounded(it):
            p = np.round(probability(m["net"], pool(b["text"], m["vectors"])), 12)     # equal texts, equal scores
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, out])
    return docs.mapInArrow(run, schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))
