"""The pipeline against plain Python, stage by stage and as a whole."""
import random
from collections import Counter

from test_corpus_operators import WORDS, brute_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def make(rng):
    word = lambda: f"w{rng.randrange(900)}"
    texts = []
    for i in range(260):
        lines = [" ".join(word() for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(2, 7))]
        if i % 6 == 0:
            lines[0] += " scum idiot"
        if i % 5 == 0:
            lines += ["shared one", "shared two", "shared three"]
        texts.append("\n".join(lines))
        if i % 7 == 0:
            texts.append(texts[-1].replace("\n", " ") + " " + word())
    return texts + [None, "", "one line"]


def test_pipeline_matches_plain_python(spark, tmp_path):
    import corpus_pipeline as cp
    from ledgerlens.llm import pieces, toxicity
    rng = random.Random(21)
    texts = make(rng)
    sources = [rng.choice(["a", "b", "b", "c", None]) for _ in texts]
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, (t, s) in enumerate(zip(texts, sources))]
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    toxic = [int(t is not None and "scum" in t) for t in texts]
    spark.createDataFrame([(i, 1, x) for i, x in enumerate(toxic) if i % 2], "doc_id long, quality int, toxic int") \
        .write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "mixing", "sentencepiece"]

    now, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        out = stage(spark, now, sf)
        path = str(tmp_path / f"after-{name}")
        out.write.parquet(path)
        if name != "sentencepiece":
            assert out.columns == docs.columns
        now = spark.read.parquet(path)
        seen[name] = sorted(now.collect(), key=lambda r: r.doc_id)

    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    kept = [r for r in rows if score[r[0]] < 0.3]
    assert [tuple(r) for r in seen["toxicity"]] == kept
    wrong = sum((score[i] >= 0.3) != bool(x) for i, x in enumerate(toxic))
    assert wrong <= 0.03 * len(rows)

    windows, lined = set(), []
    for i, t, lang, source, _ in kept:
        if t is not None:
            ls, gone = t.split("\n"), set()
            for a in range(len(ls) - 2):
                w = tuple(ls[a:a + 3])
                gone |= {a, a + 1, a + 2} if w in windows else set()
                windows.add(w)
            t = "\n".join(x for a, x in enumerate(ls) if a not in gone)
        lined.append((i, t, lang, source, None if t is None else len(t)))
    assert [tuple(r) for r in seen["line_dedup"]] == lined

    comps = brute_components([r[1] for r in lined])
    single = [r for at, (r, (_, c)) in enumerate(zip(lined, comps)) if c == at]
    assert [tuple(r) for r in seen["ngram_jaccard"]] == single and len(single) < len(lined)

    taken = Counter(r.doc_id for r in seen["mixing"])
    by_id = {r[0]: r for r in single}
    assert set(taken) <= set(by_id) and all(tuple(r) == by_id[r.doc_id] for r in seen["mixing"])
    size = lambda r: len(WORDS.findall(r[1] or ""))
    total = Counter()
    for r in single:
        total[r[3]] += size(r)
    assert all(n <= 2 for n in taken.values())
    got = Counter()
    for i, n in taken.items():
        got[by_id[i][3]] += n * size(by_id[i])
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    weight, want, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(total.values()), set()
    while True:
        left = want - sum(2 * total[s] for s in full)
        ws = sum(weight[s] for s in order if s not in full)
        target = {s: 2 * total[s] if s in full else left * weight[s] / ws for s in order}
        over = {s for s in order if s not in full and target[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    assert all(abs(got[s] - target[s]) <= 60 for s in order)

    codec = pieces.Codec(pieces.load_pieces(pieces.default_model()))
    assert Counter(r.doc_id for r in seen["sentencepiece"]) == taken
    for r in seen["sentencepiece"]:
        text = by_id[r.doc_id][1]
        assert (r.ids is None) == (text is None) and r.n_pieces == len(r.ids or [])
        if text is not None:
            assert codec.decode(r.ids) == text if text else r.ids == []
    whole = cp.run(spark, sf)
    assert Counter((r.doc_id, tuple(r.ids or ())) for r in whole.collect()) == Counter(
        (r.doc_id, tuple(r.ids or ())) for r in seen["sentencepiece"])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as cp
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_near_copies_go_whatever_their_ids(spark):
    """A near copy goes even if its id also stands on another text; rows without id; extra columns."""
    import corpus_pipeline as cp
    base = " ".join(f"a{i}" for i in range(60))
    rows = [(1, base), (2, base + " b"), (2, "something else entirely, on a row of the same id"), (None, base + " c"),
            (None, "alone"), (None, "alone"), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 9) for i, t in rows], COLUMNS + ", row long")
    got = sorted(((r.doc_id, r.text) for r in cp.drop_near_copies(spark, docs, "").collect()), key=repr)
    assert got == sorted([(1, base), rows[2], (None, "alone"), (4, None), (4, None), (5, "")], key=repr)
