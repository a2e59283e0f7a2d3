"""Steps whose cost grew faster than it had to: the same results as the plain way, and less sent."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlens.operators import evaluate as ev
from ledgerlens.operators import tfidf as tf
from ledgerlens.plans import catalog_learn as cl
from ledgerlens.plans import learn


def counted(texts, block):
    """(df, cf) per term, one piece of text lists after the other, and how often each term was sent."""
    t, df, cf, sent = tf.KeyTally(block.ngram[1], "" if block.analyzer == "char_wb" else " "), Counter(), Counter(), Counter()

    def take(batches):
        for b in batches:
            for term, d, c in zip(b["term"].to_pylist(), b["df"].to_pylist(), b["cf"].to_pylist()):
                df[term] += d
                cf[term] += c
                sent[term] += 1
    for part in texts:
        for _, g in block.batch_grams(pa.array(part)):
            assert t.fits(g)
            take(t.add(g))
    take(t.last())
    return df, cf, sent


def test_frequent_terms_are_sent_once(monkeypatch):
    """a task with more distinct terms than it may hold sends rare ones, not all, again and again."""
    monkeypatch.setattr(tf, "MERGE_ROWS", 40)
    monkeypatch.setattr(tf, "HELD_TERMS", 30)
    rows = [[f"often all w{i}{j} é{i % 3}" for j in range(3)] for i in range(60)]
    for block, parts in ((tf.BlockSpec("t", 0, (1, 2)), [[r.split() for r in part] for part in rows]),
                         (tf.BlockSpec("t", 0, (3, 5), "char_wb"), rows)):
        df, cf, sent = counted(parts, block)
        want_df, want_cf = Counter(), Counter()
        for r in (r for part in rows for r in part):
            n = block.ngram
            units = [r.split()] if block.analyzer == "word" else [f" {w} " for w in r.split()]
            grams = Counter((" " if block.analyzer == "word" else "").join(u[i:i + k]) for u in units for k in range(n[0], n[1] + 1)
                            for i in range(len(u) - k + 1))
            want_cf.update(grams)
            want_df.update(grams.keys())
        assert df == want_df and cf == want_cf
        assert sent["often" if block.analyzer == "word" else "oft"] == 1 and max(sent.values()) < 30


def test_symbols_beyond_the_room(monkeypatch):
    monkeypatch.setattr(tf, "HELD_SYMBOLS", 5)
    df, cf, _ = counted([[["a", "b", "c"]], [["d", "e", "f"], ["a"]], [[], None]], tf.BlockSpec("t", 0, (1, 2)))
    assert cf == Counter(["a", "b", "c", "a b", "b c", "d", "e", "f", "d e", "e f", "a"]) and df == cf


def test_transform_of_chosen_blocks_and_columns(spark):
    texts = spark.createDataFrame([(1, "aa bb aa", "cc dd", "aa bb aa cc dd"), (2, "aa", "", "aa "), (None, "bb cc", "cc", "bb cc cc")],
                                  "doc_id long, desc string, rem string, chr string")
    m = tf.TfidfVectorizer(tuple(tf.BlockSpec(b.name, 50, b.ngram, b.analyzer, 1, None) for b in tf.LEDGER_BLOCKS)).fit(texts)
    whole = m.transform(texts).filter("block = 'chr'").select("doc_id", "weight").collect()
    some = m.transform(texts, ("chr",), ("doc_id", "weight"))
    assert some.columns == ["doc_id", "weight"] and Counter(some.collect()) == Counter(whole) and len(whole) > 10


def test_top_k_of_odd_arrays(spark):
    rows = [[0.1, 0.5, 0.4, 0.0], [0.25, 0.25, 0.25, 0.25], [0.5, 0.2, 0.2, 0.1], [0.0, 0.0, 1.0, 0.0], [0.3, 0.7], [1.0], [], [-1.0, -2.0, -3.0, -0.5],
            [0.2, None, 0.3, 0.5], [float("nan"), 0.1, 0.2, 0.7], [0.1, 0.2, 0.3, 0.3], None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p array<double>")
    indexed = F.transform("p", lambda x, i: F.struct((-x).alias("neg"), i.alias("idx")))
    for k in (1, 3):
        plain = F.transform(F.slice(F.sort_array(indexed), 1, k), lambda s: F.struct(s["idx"].alias("idx"), (-s["neg"]).alias("p")))
        assert [str(r) for r in df.select("i", ev.top_k(F.col("p"), k).alias("b")).orderBy("i").collect()] == \
            [str(r) for r in df.select("i", plain.alias("b")).orderBy("i").collect()]


def test_vectors_in_order_of_columns():
    blocks = (tf.BlockSpec("a", 9, (1, 1)), tf.BlockSpec("b", 9, (1, 1)))
    batch = pa.RecordBatch.from_arrays([pa.array([["y", "x"], [], ["z"]]), pa.array([["k"], ["k", "l"], None]),
                                        pa.array([[0.0, 2.0], [3.0, 0.0], [0.0, 0.0]])], names=["__u_a", "__u_b", "__dense"])
    tables = [(blocks[0], (pa.array(["x", "y"]), np.ones(2), None)), (blocks[1], (pa.array(["k", "l"]), np.ones(2), None))]
    got = learn.vector_batch(batch, tables, 2).to_pylist()
    assert [g["indices"] for g in got] == [[0, 1, 2, 5], [2, 3, 4], []] and {g["size"] for g in got} == {6}
    assert np.allclose(got[0]["values"], [0.5 ** 0.5, 0.5 ** 0.5, 1.0, 2.0]) and np.allclose(got[1]["values"], [0.5 ** 0.5, 0.5 ** 0.5, 3.0])


class Scorer:
    def __init__(self, shift):
        self.shift = shift

    def score(self, df, keep=None):
        return df.select(*(keep or ["txn_id"]), F.array(F.col("x") + F.lit(self.shift), F.lit(0.5)).alias("proba"), F.lit(0).alias("y_pred"))


def test_round_trip_exchanges_no_scores(spark, monkeypatch):
    """scores are compared where they are made; ids that are repeated give every pair, as a join does."""
    monkeypatch.setattr(cl, "_registered", lambda *a: None)

    def asked(ids, shift):
        va = spark.createDataFrame([(i, 0.25) for i in ids], "txn_id long, x double")
        monkeypatch.setattr(cl, "fitted", lambda *a: Scorer(0.0))
        monkeypatch.setattr(cl, "load_bundle", lambda *a: Scorer(shift))
        monkeypatch.setattr(cl, "_split", lambda *a: (None, va))
        return cl.q_registry_round_trip(spark, "none")
    out = asked([1, 2, None], 0.0)
    assert sorted(map(tuple, out.collect())) == [(1, 1), (2, 1)]
    assert "Join Inner" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, asked([1, 2, 2], 0.0).collect())) == [(1, 1)] + [(2, 1)] * 4
    assert sorted(map(tuple, asked([1, 2, 2], 0.1).collect())) == [(1, 0)] + [(2, 0)] * 4
