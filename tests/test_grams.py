"""n-grams as numbers against plain Python, and the vocabularies counted from them."""
import random
from collections import Counter

import pyarrow as pa
import pytest

from ledgerlens.functions import grams as gr


def plain(row, lo, hi, chars):
    words = (row or "").split() if chars else row or []
    out = []
    for unit in [f" {w} " for w in words] if chars else [words]:
        for n in range(lo, hi + 1):
            out += [(unit if chars else list(unit))[i:i + n] for i in range(len(unit) - n + 1)]
    return [g if chars else " ".join(g) for g in out]


@pytest.mark.parametrize("chars, lo, hi", [(True, 3, 5), (True, 2, 4), (False, 1, 2), (False, 2, 3), (False, 1, 1)])
@pytest.mark.parametrize("piece", [10, 1 << 20])
def test_grams_as_plain_python(monkeypatch, chars, lo, hi, piece):
    monkeypatch.setattr(gr, "PIECE", piece)
    rng = random.Random(3)
    # the long row has more symbols than five digits of a number allow
    texts = [None, "", " ", "a", "ab  été\tœ", "x　yz 😀b", " ".join(chr(0x4E00 + i) for i in range(9000)), "aaaa aaaa",
             *[" ".join("".join(rng.choices("abcé-1", k=rng.randrange(1, 9))) for _ in range(rng.randrange(20))) for _ in range(60)]]
    rows = texts if chars else [t if t is None else t.split() for t in texts]
    column = pa.array(rows, pa.string() if chars else pa.list_(pa.string()))[2:]
    rows = rows[2:]
    df, cf, of_row = Counter(), Counter(), {}
    for first, g in gr.grams(column, lo, hi, chars):
        key, d, c = g.totals()
        names = g.strings(key).to_pylist()
        assert len(set(names)) == len(names)
        df.update(dict(zip(names, d.tolist())))
        cf.update(dict(zip(names, c.tolist())))
        terms = ["ab", "aa", "aaa", " a", "aaaa", "a", "zz", " ab ", "été", "aaaa aaaa", "é"]
        for r, i in zip(g.row.tolist(), g.codes(terms).tolist()):
            if i >= 0:
                of_row.setdefault((first + r, terms[i]), 0)
                of_row[first + r, terms[i]] += 1
    want = [Counter(plain(r, lo, hi, chars)) for r in rows]
    assert cf == sum(want, Counter())
    assert df == Counter(t for w in want for t in w)
    assert of_row == {(r, t): n for r, w in enumerate(want) for t, n in w.items() if t in terms}


def test_tally_sends_what_merging_leaves(monkeypatch):
    from ledgerlens.operators import tfidf as tf
    monkeypatch.setattr(tf, "MERGE_ROWS", 10)
    t, sent = tf.Tally(("df", "cf")), Counter()
    for i in range(40):
        terms = [f"t{j % (3 if i < 20 else 1000)}" for j in range(i * 4, i * 4 + 4)]
        t.add(pa.array(terms), *([1] * 4, [2] * 4))
        for b in t.taken(i == 39):
            for r in b.to_pylist():
                sent[r["term"]] += r["cf"]
        assert t.rows <= 14
    assert sum(sent.values()) == 320 and len(sent) > 80


def test_rows_that_share_an_id_are_one_document(spark):
    from ledgerlens.operators import tfidf as tf
    rows = [(1, "ab ab cd"), (1, "cd ef"), (2, "ab cd"), (None, "ef"), (None, "ef ab"), (3, None), (4, "")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["term"]: (r["df"], r["cf"]) for r in tf.id_stats(texts, (tf.BlockSpec("text", 0, (1, 2)),)).collect()}
    assert got == {"ab": (3, 4), "cd": (2, 3), "ef": (2, 3), "ab ab": (1, 1), "ab cd": (2, 2), "cd ef": (1, 1), "ef ab": (1, 1)}


def test_vocabulary_ships_units_not_ngrams(spark):
    """What goes to the task's Python is a row's words or text, not one string per n-gram."""
    from ledgerlens.operators import tfidf as tf
    texts = spark.createDataFrame([(1, "ab cd ef", "ab cd")], "doc_id long, desc string, chr string")
    blocks = (tf.BlockSpec("desc", 10, (1, 2)), tf.BlockSpec("chr", 10, (3, 5), analyzer="char_wb"))
    row = tf.unit_columns(texts, blocks).first()
    assert row["__u_desc"] == ["ab", "cd", "ef"] and row["__u_chr"] == "ab cd"


def test_pieces_hold_a_quarter_million_symbols_at_most():
    column = pa.array([["a", "b"] * 50_000] * 8 + [["c"] * 300_000])
    sizes = [sum(len(r) for r in part.to_pylist()) for _, part in gr._pieces(column)]
    assert sum(sizes) == 1_100_000 and sizes[-1] == 300_000 and max(sizes[:-1]) <= 1 << 18


def test_written_rows_are_shared_out_by_files(spark):
    from ledgerlens.session import written
    df = written(spark.range(0, 1000, 1, 1), "shared-out", 100)
    assert len(df.inputFiles()) == 10 and sorted(r["id"] for r in df.collect()) == list(range(1000))
    assert len(written(spark.range(0, 1000, 1, 1), "together").inputFiles()) == 1
