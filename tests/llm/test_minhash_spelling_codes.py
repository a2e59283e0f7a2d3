"""MinHash components, spelling variants and vector codes against plain Python, on awkward rows."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product
from math import comb, floor

import numpy as np
import pytest

from test_corpus_operators import clashing, corpus, frame

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# ------------------------------------------------------------------ MinHash
def sets_of(texts, gram):
    out = []
    for t in texts:
        w = WORDS.findall(low(t or ""))
        out.append(set() if not w else {tuple(w)} if len(w) < gram else {tuple(w[i:i + gram]) for i in range(len(w) - gram + 1)})
    return out


def brute_components(texts, gram=3, num=85, den=100):
    sets, up = sets_of(texts, gram), list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and den * i >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


def answer(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("seed, block", [(1, 4), (2, 384), (3, 7)])
def test_minhash_components(spark, seed, block, monkeypatch):
    from ledgerlens.llm import minhash
    monkeypatch.setattr(minhash, "BLOCK", block)                   # lists cut into many cells
    texts = corpus(seed, n=150, long=160)
    assert answer(minhash.minhash_components(clashing(frame(spark, texts)))) == brute_components(texts)


def test_minhash_family_without_its_original(spark, monkeypatch):
    """Copies that each differ elsewhere, most of them linked to some others only: hubs do not settle the lists."""
    from ledgerlens.llm import minhash
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rng, texts = random.Random(8), []
    base = [f"v{i}" for i in range(150)]
    for _ in range(60):
        ws = list(base)
        for at in rng.sample(range(150), rng.choice([2, 3, 4])):
            ws[at] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(ws))
    texts += [" ".join(base[:k]) for k in range(100, 150, 3)]      # growing sizes: neighbouring size bands
    want = brute_components(texts)
    assert answer(minhash.minhash_components(frame(spark, texts))) == want
    assert len({c for _, c, _ in want.values()}) > 1


def test_minhash_at_the_threshold(spark):
    """Sets of 85 and 100 n-grams, one within the other, link (exactly 0.85); 84 of 100 do not."""
    from ledgerlens.llm.minhash import minhash_components
    ws = [f"t{i}" for i in range(102)]
    texts = [" ".join(ws), " ".join(ws[:87]), "", " ".join(w + "x" for w in ws), " ".join(w + "x" for w in ws[:86])]
    assert answer(minhash_components(frame(spark, texts))) == {
        0: (100, 0, True), 1: (85, 0, False), 2: (0, 2, True), 3: (100, 3, True), 4: (84, 4, True)}


def test_minhash_repeated_and_null_ids(spark):
    from ledgerlens.llm.minhash import minhash_components
    long = " ".join(f"a{i}" for i in range(60))
    rows = [(None, long), (None, long), (7, long), (7, long + " b"), (9, "other text here"), (9, long + " b c"),
            (None, "alone without id"), (3, None), (4, " \n")]
    got = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_components(
        spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[:6] == [(False, 3, 0, 3, True), (False, 4, 0, 4, True), (False, 7, 58, 7, True), (False, 7, 59, 7, True),
                       (False, 9, 1, 9, True), (False, 9, 60, 7, False)]
    assert sorted(map(repr, got[6:])) == sorted(map(repr, [(True, None, 58, 7, False)] * 2 + [(True, None, 1, None, True)]))


def test_minhash_long_text_and_empty_table(spark):
    from ledgerlens.llm.minhash import minhash_components
    ws = [f"k{i}" for i in range(120_000)]
    texts = [" ".join(ws), " ".join(ws[:-50]), " ".join(ws[:60_000])]
    assert answer(minhash_components(frame(spark, texts))) == {
        0: (119_998, 0, True), 1: (119_948, 0, False), 2: (59_998, 2, True)}
    assert minhash_components(frame(spark, texts).limit(0)).collect() == []


def test_match_threshold_is_the_binomial_tail():
    from ledgerlens.llm.minhash import match_threshold
    t = match_threshold(85, 100, 64)
    miss = lambda t: sum(comb(64, i) * 0.85 ** i * 0.15 ** (64 - i) for i in range(t))
    assert t == 36 and miss(t) <= 2e-8 < miss(t + 1)


def test_signatures_estimate_similarity():
    import pyarrow as pa
    from ledgerlens.llm import minhash
    from ledgerlens.llm.jaccard import sets_of as hashed
    rng = random.Random(3)
    a = [f"w{rng.randrange(10 ** 6)}" for _ in range(400)]
    b = a[:300] + [f"w{rng.randrange(10 ** 6)}" for _ in range(100)]
    h, _, size = hashed(pa.array([" ".join(a), " ".join(b), ""]), 3)
    sig = minhash.signatures(h, size, minhash.multipliers(2048))
    s = sets_of([" ".join(a), " ".join(b)], 3)
    assert abs((sig[0] == sig[1]).mean() - len(s[0] & s[1]) / len(s[0] | s[1])) < 0.04
    assert (sig[2] == 0xFFFFFFFF).all()


def test_block_intersections_and_skips(monkeypatch):
    from ledgerlens.llm import minhash
    monkeypatch.setattr(minhash, "COLUMNS", 16)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 60))).astype(np.uint64) for _ in range(20)]
    got = minhash.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i, j in product(range(20), repeat=2))
    sig = rng.integers(0, 3, (20, 30)).astype(np.uint32)
    pairs = np.triu(rng.random((20, 20)) < 0.7, 1)
    want = pairs & ((sig[:, None, :] == sig[None, :, :]).sum(2) >= 12)
    assert (minhash.collisions(sig, pairs, 12) == want).all()


# ----------------------------------------------------------------- spelling
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def brute_spelling(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in LETTERS.findall(text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    letters = sorted({c for w in n for c in w})

    def edits(w):
        for i in range(len(w) + 1):
            yield from (w[:i] + c + w[i:] for c in letters)
            if i < len(w):
                yield w[:i] + w[i + 1:]
                yield from (w[:i] + c + w[i + 1:] for c in letters)
    near = {w: {e for e in edits(w) if e in n and e != w} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n}


def spelled(seed, docs=60):
    rng = random.Random(seed)
    letters = "abcdeghinorstuéßÀ"
    roots = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 13))) for _ in range(25)] + ["anagramme", "margamane", "aaaaaaaa", "aaaaaaa"]

    def spoil(w):
        i, kind = rng.randrange(len(w)), rng.randrange(3)
        return w[:i] + (rng.choice(letters) if kind else "") + w[i + (kind != 1):]
    out = []
    for i in range(docs):
        ws = []
        for _ in range(300):
            w = rng.choice(roots[:8] * 6 + roots)
            if rng.random() < 0.05:
                w = spoil(w)
                if rng.random() < 0.3:
                    w = spoil(w)
            ws.append(w.upper() if rng.random() < 0.05 else w)
        out.append((i, rng.choice([" ", ", ", "_", "1"]).join(ws)))
    return out + [(None, "anagramme anagramme Anagramme"), (None, None), (5, ""), (5, out[5][1]), (7, "short words only"),
                  (8, "chainword " * 450 + "chainwore " * 33 + "chainware " * 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_variants(spark, seed):
    from ledgerlens.llm.spelling import spelling_variants
    rows = spelled(seed)
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).withColumnRenamed("h", "word")
    got = {tuple(r) for r in spelling_variants(df).collect()}
    assert got == brute_spelling(rows)
    assert any(f is not None and r != f for _, _, _, f, _, r in got)           # a chain of forms


def test_spelling_roots_of_a_long_chain(spark):
    from ledgerlens.llm.spelling import roots
    chain = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("x", "w4")]
    assert {r.word: r.root for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()} == {
        **{f"w{i}": "w11" for i in range(11)}, "x": "w11"}


def test_spelling_of_nothing(spark):
    from ledgerlens.llm.spelling import spelling_variants
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    assert spelling_variants(df).collect() == [] and spelling_variants(df.limit(0)).collect() == []


def test_spelling_of_a_very_long_text(spark):
    from ledgerlens.llm.spelling import word_counts
    text = "wonderful " * 200_000 + "x" * 100_000
    got = {r.word: r.n for r in word_counts(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()}
    assert got["wonderful"] >= 200_000 and got["x" * 100_000] == 2


def test_signatures_of_near_words_meet():
    from ledgerlens.llm.spelling import signatures
    rng = random.Random(6)
    for _ in range(200):
        w = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(7, 12)))
        i = rng.randrange(len(w))
        v = rng.choice([w[:i] + w[i + 1:], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1:], w[:i] + "a" + w[i:]])
        s = signatures([w, v])
        assert set(s[0].tolist()) & set(s[1].tolist()) and s.shape == (2, 24)


# ------------------------------------------------------------- vector codes
def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [floor(1024 * np.float64(x)) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for dim in {len(v) for _, v, _ in kept}:
        same = sorted((r for r in kept if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0], r[1]))
        at = np.cumsum([0] + [len(p) for p in np.array_split(range(dim), parts)]).tolist()
        cut = [[v[a:z] for a, z in zip(at[:-1], at[1:])] for _, v, _ in same]
        books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

        def assign(c, p):
            d = [sum((x - y) ** 2 for x, y in zip(c[p], e)) for e in books[p]]
            return d.index(min(d)), min(d)
        for _ in range(rounds):
            new = []
            for p in range(parts):
                members = defaultdict(list)
                for c in cut:
                    members[assign(c, p)[0]].append(c[p])
                new.append([[sum(x) // len(members[e]) for x in zip(*members[e])] if e in members else books[p][e]
                            for e in range(len(books[p]))])
            books = new
        sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for (i, v, label), c in zip(same, cut):
            found = [assign(c, p) for p in range(parts)]
            out.setdefault((i, tuple(v)), []).append((label, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found), sha))
    total = Counter()
    for rs in out.values():
        for label, _, error, _ in rs:
            total[label] += error
    return sorted(repr((i, label, code, error, total[label], sha)) for (i, _), rs in out.items() for label, code, error, sha in rs)


def vectors(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = [(int(i), (centres[i % 6] + rng.normal(size=dim) * 0.2).astype(np.float32).tolist(), None if i % 5 == 0 else int(i % 3)) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    return rows + [(n, None, 1), (n + 1, [nan] * dim, 1), (n + 2, [inf] + [0.0] * (dim - 1), 1), (n + 3, [None] * dim, 1),
                   (3, rows[3][1], 2), (3, rows[4][1], 2), (None, rows[5][1], None), (n + 4, [0.0] * dim, 0), (n + 5, [-100.0] * dim, 0)]


def coded(df, **kw):
    from ledgerlens.llm.vector_codes import vector_codes
    return sorted(repr((r.vec_id, r.label, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in vector_codes(df, **kw).collect())


@pytest.mark.parametrize("entries, residents", [(16, 4096), (256, 8), (3, 1)])
def test_vector_codes(spark, entries, residents, monkeypatch):
    from ledgerlens.llm import vector_codes
    monkeypatch.setattr(vector_codes, "RESIDENTS", residents)      # owners of few members: many salts
    rows = vectors(1, 150)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    for name in ("k", "v", "dim", "pos", "entry", "salt", "data", "of", "error", "code"):
        df = df.withColumn(name, df.vec_id)
    want = brute_codes(rows, entries=entries)
    assert coded(df, entries=entries) == want
    assert coded(df.repartition(2), entries=entries) == want       # however the rows are dealt


def test_vector_codes_of_several_lengths(spark):
    rows = vectors(2, 30) + [(100 + i, [float(i), -0.5, 1.25, 2.0, 0.1, 7.0], 1) for i in range(9)] + [(200, [], 0), (201, [1.5], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert coded(df, entries=8) == brute_codes(rows, entries=8)


def test_vector_codes_of_nothing(spark):
    df = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert coded(df) == [] and coded(df.limit(0)) == []
    assert len(coded(spark.createDataFrame([(1, [0.5] * 8)], "vec_id long, embedding array<float>"))) == 1


def test_nearest_is_exact():
    from ledgerlens.llm.vector_codes import nearest
    rng = np.random.default_rng(5)
    for top in (1 << 10, 1 << 27):
        x, e = rng.integers(-top, top, (40, 6)), rng.integers(-top, top, (9, 6))
        e[4] = e[2]
        far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c)) for c in e] for r in x]
        index, least = nearest(x, e)
        assert index.tolist() == [d.index(min(d)) for d in far] and least.tolist() == [min(d) for d in far]


def test_far_components_are_clipped(spark):
    from ledgerlens.llm.vector_codes import vector_codes
    rows = [(0, [0.0] * 4), (1, [3e38, -3e38, 0.0, 0.0])]
    got = {r.vec_id: (r.code, r.error) for r in vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), entries=1).collect()}
    half = (1 << 27) // 2
    assert got == {0: ("00000000", 2 * half * half), 1: ("00000000", 2 * half * half)}
