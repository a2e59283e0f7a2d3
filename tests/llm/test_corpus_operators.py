"""The corpus operators against plain Python, on awkward rows."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, sources=None):
    """Rows with ids by position; an extra column and a hash-like name that could clash with inner ones."""
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    from pyspark.sql import functions as F
    for name in ("h", "k", "n", "w1", "pos", "score_", "size", "part", "gone", "turn", "component", "bucket", "score", "ids", "decoded", "n_removed", "shared", "once"):
        df = df.withColumn(name, F.lit("x"))
    return df


def corpus(seed, n=120, vocabulary=60, long=90):
    """Families of edited copies with similarities on both sides of the threshold, shared passages, copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary * 20)}"
    out = []
    passage = [word() for _ in range(50)]
    while len(out) < n:
        base = [word() for _ in range(rng.randrange(5, long))]
        for _ in range(rng.randrange(1, 12)):
            ws = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                ws[rng.randrange(len(ws))] = word()
            if rng.random() < 0.2:
                ws = ws[rng.randrange(4):]
            if rng.random() < 0.2:
                ws += passage
            text = " ".join(ws)
            out.append(text.upper() if rng.random() < 0.1 else text)
    out[3], out[7], out[9], out[11] = None, "", " \t\n ", "two words"
    out[12], out[13] = "two  words", "Two Words"
    return out


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)})
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed, monkeypatch):
    from ledgerlens.llm import jaccard
    monkeypatch.setattr(jaccard, "BLOCK", 4)                       # tiles cut into blocks
    texts = corpus(seed)
    got = jaccard.jaccard_components(clashing(frame(spark, texts))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == dict(enumerate(brute_components(texts)))


def test_jaccard_repeated_and_null_ids(spark):
    from ledgerlens.llm.jaccard import jaccard_components
    long = " ".join(f"a{i}" for i in range(40))
    df = spark.createDataFrame([(None, long), (7, long), (7, long + " b"), (9, "other text here"), (9, long + " b c")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in jaccard_components(df).collect())
    assert got == [(False, 7, 7), (False, 7, 7), (False, 9, 7), (False, 9, 9), (True, None, 7)]


def test_overlap_bound_is_an_upper_bound():
    import pyarrow as pa
    from ledgerlens.llm import jaccard
    texts = [t for t in corpus(5) if t]
    h, row, size = jaccard.sets_of(pa.array(texts), 5)
    bits = jaccard.bitmaps(h, row, size)
    sets = [set(h[row == i].tolist()) for i in range(len(texts))]
    for a in range(0, len(texts), 3):
        for b in range(len(texts)):
            assert jaccard.overlap_bound(bits[a], bits[b], len(sets[a]), len(sets[b])) >= len(sets[a] & sets[b])


def test_mixing(spark):
    from ledgerlens.llm.mixing import mix_sources
    rng = random.Random(4)
    names = [None, "b", "a", "é", "Z", "empty"]
    texts, sources = [], []
    for _ in range(3000):
        s = rng.choice(names[:5] + ["b"] * 10)
        texts.append(rng.choice(["", None, "x", " ".join("w" * rng.randrange(1, 30))]) if s != "empty" else "")
        sources.append(s)
    texts += ["", None]
    sources += ["empty", "empty"]
    got = mix_sources(clashing(frame(spark, texts, sources))).collect()
    again = mix_sources(frame(spark, texts, sources).repartition(5)).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}
    size = [len(WORDS.findall(t or "")) for t in texts]
    total = Counter()
    for s, n in zip(sources, size):
        total[s] += n
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, full = 1.5 * sum(size), set()
    while True:                                                    # the contract's own loop
        rest = want - sum(2 * total[s] for s in full)
        ws = sum(weight[s] for s in order if s not in full)
        target = {s: 2 * total[s] if s in full else rest * weight[s] / ws for s in order}
        over = {s for s in order if s not in full and target[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for r in got:
        s = sources[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s])
        assert r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(40, 0.02 * target[s])


def test_line_dedup(spark):
    from ledgerlens.llm.line_dedup import dedup_lines
    rng = random.Random(8)
    block = ["l1", "l2", "l3", "l4"]
    texts = []
    for _ in range(60):
        ls = []
        for _ in range(rng.randrange(1, 9)):
            ls += rng.choice([block, [f"u{rng.randrange(50)}"], ["x"] * 5, [""] * 3, block[:2]])
        texts.append("\n".join(ls))
    texts += [None, "", "a\nb", "a\nb", "\n".join(block), "q\n" + "\n".join(block) + "\nr"]
    seen, expect = set(), []
    for t in texts:
        if t is None:
            expect.append((None, 0, 0))
            continue
        ls = t.split("\n")
        gone = set()
        for i in range(len(ls) - 2):
            w = tuple(ls[i:i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        expect.append(("\n".join(x for i, x in enumerate(ls) if i not in gone), len(ls), len(gone)))
    got = dedup_lines(clashing(frame(spark, texts))).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got} == dict(enumerate(expect))


def test_toxicity_learns_words(spark):
    from ledgerlens.llm import toxicity
    rng = random.Random(6)
    texts = []
    for i in range(800):
        ws = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        if i % 5 == 0:
            ws.insert(rng.randrange(len(ws)), rng.choice(["Idiot", "scum!", "vile"]))
        texts.append(" ".join(ws))
    texts += [None, "", "scum"]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(800)] + [(None, 1, 1), (3, None, None)],
                                   "doc_id long, quality int, toxic int")
    docs = clashing(frame(spark, texts))
    model = toxicity.train(docs, labels)
    assert 0 < len(model["at"]) < 2000                              # L1 leaves few weights
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    out = [i for i in range(800) if zlib.crc32(str(i).encode()) % 4 == 2]
    hits = sum((got[i] >= 0.3) == (i % 5 == 0) for i in out)
    assert hits >= 0.97 * len(out)
    assert got[800] == got[801] and got[802] >= 0.3
    assert toxicity.train(docs, labels.limit(0)) is None


def test_ftrl_weights_ignore_held_out_rows(spark):
    from ledgerlens.llm.learn import labelled_sample
    docs = frame(spark, ["a"] * 200)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    ids = {r.doc_id for r in labelled_sample(docs, labels, "toxic", 1000).collect()}
    assert ids == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert 20 < labelled_sample(docs, labels, "toxic", 60).count() < 100


def test_url_filter(spark):
    from ledgerlens.llm.url_filter import filter_urls
    link = '<html><LINK href="{}" rel=\'canonical\'></html>'
    rows = [(0, "https://www.Example.org/es/1?x#y", ""), (1, "http://example.org/en/12", None), (2, "http://a.org/q", "<p>"),
            (3, None, ""), (4, "no-scheme.org/es/", ""), (5, "http://notexample.org", ""), (6, "ftp://x.com/fr/", ""),
            (7, "http://x.com/de/a", ""), (8, "http://free.net/a", link.format("http://x.com/de/a")),
            (9, "http://free.net/b", '<meta http-equiv="refresh" content="0; url=/a">'),
            (10, "http://both.net/", link.format("http://x.com/de/z")), (11, "http://both.net/?utm_source=u", link.format("https://k.org/w")),
            (12, "http://free.net/c", ""), (13, "https://free.net/a/#top", ""), (14, "://", "")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    moved = spark.createDataFrame([("http://hop.net/1", "http://free.net/b"), (None, "http://q/")], "from_url string, to_url string")
    more = spark.createDataFrame([(20, "http://hop.net/1", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(
        pages.select("page_id", "url", "html").union(more), redirects=moved).collect()}
    assert got[0] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[2] == ("a.org", "/q", "org/", "allow")
    assert got[3] == got[4] == got[14] == ("", "", None, "allow")
    assert got[5] == ("notexample.org", "", None, "allow")
    assert got[6][2:] == ("com/fr/", "allow") and got[7][2:] == ("com/de/", "block")
    assert got[8][3] == got[9][3] == got[13][3] == got[20][3] == "block"      # aliases of a blocked page
    assert got[10][3] == got[11][3] == "allow"                                # an explicit allow in the component
    assert got[12][3] == "allow"


def test_connected_components(spark):
    from ledgerlens.llm.components import connected_components
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)]
    edges += [(500, i) for i in range(501, 620)] + [(5, 5), (None, 4), (1, 0)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in up}


def test_quality_network(spark):
    from ledgerlens.llm import quality
    rng = random.Random(1)
    texts = []
    for i in range(700):
        ws = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(8, 50))]
        texts.append(" ".join(w.upper() + "!!" for w in ws) if i % 3 == 0 else " ".join(ws))
    texts += [None, "", "  "]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(700)], "doc_id long, quality int, toxic int")
    docs = clashing(frame(spark, texts))
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    out = [i for i in range(700) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= 0.5) == (i % 3 > 0) for i in out) >= 0.97 * len(out)
    assert got[700] == got[701] == got[702] and all(0 <= s <= 1 for s in got.values())
    one = quality.train(docs, labels.filter("quality = 1"))
    assert one == {"constant": 1.0} and quality.train(docs, labels.limit(0)) == {"constant": 0.5}
    parts = quality.word_vectors(docs.repartition(7))
    assert np.array_equal(parts, model["vectors"])                   # sums do not depend on the tasks


def brute_windows(texts, width=35):
    c, ws = Counter(), [(t or "").encode().split() for t in texts]
    for w in ws:
        c.update(tuple(w[i:i + width]) for i in range(len(w) - width + 1))
    out = []
    for w in ws:
        gone = set()
        for i in range(len(w) - width + 1):
            if c[tuple(w[i:i + width])] > 1:
                gone |= set(range(i, i + width))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def test_substring_dedup(spark):
    from ledgerlens.llm.substring_dedup import dedup_substrings, difference_cover
    assert len(difference_cover(21)) == 5
    rng = random.Random(3)
    passages = [[f"p{i}_{j}" for j in range(n)] for i, n in enumerate((34, 35, 36, 60, 120))]
    texts = []
    for _ in range(80):
        ws = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = p[rng.randrange(3):]
        texts.append(rng.choice([" ", "\n"]).join(ws))
    texts += [None, "", " ", "again " * 40, "é " * 36, texts[0], texts[1]]
    got = dedup_substrings(clashing(frame(spark, texts)).repartition(6)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == dict(enumerate(brute_windows(texts)))
    twice = spark.createDataFrame([(None, texts[0]), (None, texts[0]), (4, " ".join(f"x{i}" for i in range(50)))], "doc_id long, text string")
    assert sorted(r.n_removed == r.n_words for r in dedup_substrings(twice).collect()) == [False, True, True]


def test_nearest_neighbours(spark, monkeypatch):
    from ledgerlens.llm import ann
    monkeypatch.setattr(ann, "BLOCK_V", 40)
    monkeypatch.setattr(ann, "BLOCK_Q", 3)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 24)) * rng.uniform(0.5, 2, size=(1200, 1))
    x[100:160] = x[100]                                              # copies, and a query among them
    rows = [(i, [float(v) for v in x[i]]) for i in range(1200)]
    rows += [(5000, None), (5100, [0.0] * 24), (5200, [float("nan")] + [1.0] * 23), (5300, [None] + [1.0] * 23), (5400, [1.0] * 3),
             (None, [1.0] * 24), (3, rows[3][1])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = defaultdict(list)
    for r in ann.search(df, lambda i: i % 100 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    found = 0
    for q in range(0, 1200, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1200), d))[:10]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(s == pytest.approx(d[v], abs=1e-12) for _, v, s in mine)
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        found += len({v for _, v, _ in mine} & set(best.tolist()))
    assert set(got) == set(range(0, 1200, 100)) and found >= 0.9 * 120
    assert sorted(v for _, v, _ in got[100]) == list(range(101, 111))
    few = ann.search(df.filter("vec_id < 4"), lambda i: i % 100 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]


def test_winnowing(spark):
    from ledgerlens.llm.winnow import edited_fingerprints
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "b", "é", "word", "x" * 9]) for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    texts += [None, "", " \n", "single", texts[0]]
    signed = lambda u: u - (1 << 64) if u >> 63 else u

    def chain(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64(v.to_bytes(8, "little"), seed=seed).intdigest()
        return seed

    def prints(t):
        h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in WORDS.findall(t)]
        g = [] if not h else [chain(h)] if len(h) < 5 else [chain(h[i:i + 5]) for i in range(len(h) - 4)]
        out = []
        for s in range(max(1, len(g) - 15) if g else 0):
            i = -min((signed(g[i]) >> 30, -i) for i in range(s, min(len(g), s + 16)))[1]
            if not out or out[-1][0] != i:
                out.append((i, signed(g[i])))
        return out

    def like(a, b):
        a, b = {h for _, h in a}, {h for _, h in b}
        return 1.0 if not a | b else len(a & b) / len(a | b)
    got = {r.doc_id: r for r in edited_fingerprints(clashing(frame(spark, texts)).repartition(5)).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        half = len(t) // 2
        e = t[:len(t) - half] + after[:half]
        r, p = got[i], prints(t)
        assert (r.n_chars, r.edited, list(zip(r.pos, r.hash))) == (len(t), e, p)
        assert r.near_edited == pytest.approx(like(p, prints(e))) and r.near_next == pytest.approx(like(p, prints(after)))
    assert got[44].hash == got[0].hash


def test_sentencepiece_round_trip(spark):
    from ledgerlens.llm import pieces
    model = pieces.share(spark)
    codec = pieces.Codec(model.value)
    texts = ["", " ", "a b", "  two  spaces ", "line\nnext\n\n end", "é丁🙂▁lit▁￿", "<s> <0x41> <unk>", "x" * 300,
             "the quick brown fox " * 5, None, "the quick brown fox " * 5]
    df = pieces.decode(pieces.encode(clashing(frame(spark, texts)), model), model)
    got = {r.doc_id: (r.ids, r.decoded) for r in df.collect()}
    assert {i: d for i, (_, d) in got.items()} == dict(enumerate(texts))
    score = {p: (s, i) for i, (p, s, k) in enumerate(model.value["pieces"]) if k == "n"}
    price = [s for _, s, _ in model.value["pieces"]]

    def best(text):                                                   # plain dynamic programme over all substrings
        t = (" " + text).replace("▁", "￿").replace(" ", "▁")
        at = [0.0]
        for e in range(1, len(t) + 1):
            options = [at[s] + score[t[s:e]][0] for s in range(max(0, e - 20), e) if t[s:e] in score]
            at.append(max(options) if options else at[e - 1] + codec.unknown)
        return at[-1]
    for i, t in enumerate(texts):
        if t:
            own = sum(price[x] for x in got[i][0] if model.value["pieces"][x][2] == "n")
            spelled = sum(model.value["pieces"][x][2] == "b" for x in got[i][0])
            letters = len(bytes(b for x in got[i][0] if model.value["pieces"][x][2] == "b" for b in codec.out[x]).decode())
            assert own + letters * codec.unknown == pytest.approx(best(t)), (t, spelled)
    assert got[9] == (None, None) and got[0] == ([], "")


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables(spark):
    from ledgerlens.llm import ann, jaccard, line_dedup, mixing, pieces, quality, substring_dedup, toxicity, url_filter, winnow
    docs = spark.createDataFrame([], EMPTY)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert jaccard.jaccard_components(docs).count() == 0
    assert mixing.mix_sources(docs).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert quality.score(docs, quality.train(docs, labels)).count() == 0
    assert substring_dedup.dedup_substrings(docs).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 100 == 0).count() == 0
    assert line_dedup.dedup_lines(docs).count() == 0
    assert winnow.edited_fingerprints(docs).count() == 0
    model = pieces.share(spark)
    assert pieces.decode(pieces.encode(docs, model), model).count() == 0


def test_very_long_text(spark):
    """One text of some megabytes beside small ones."""
    from ledgerlens.llm import jaccard, line_dedup, substring_dedup, winnow
    rng = random.Random(12)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300_000))
    docs = frame(spark, [long, "short text", long + " end", "x" * 2_000_000])
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3}
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(docs).collect()}
    assert cut == {0: (300_000, 300_000), 1: (2, 0), 2: (300_001, 300_000), 3: (1, 0)}
    assert line_dedup.dedup_lines(docs).filter("n_removed > 0").count() == 0
    assert winnow.edited_fingerprints(docs.filter("doc_id > 0")).count() == 3


def test_neighbours_of_other_lengths(spark, monkeypatch):
    """One overlong row, and a few short ones, leave the others' neighbours as they are."""
    from ledgerlens.llm import ann
    monkeypatch.setattr(ann, "BLOCK_V", 40)
    x = np.random.default_rng(8).normal(size=(300, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(300)]
    rows += [(1000, [1.0] * 9)] + [(1100 + i, [float(i), 1.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in sorted(ann.search(df, lambda i: i % 100 == 0).collect(), key=lambda r: r.rank):
        got[r.query_id].append(r.vec_id)
    assert set(got) == {0, 100, 200, 1100} and got[1100] == [1101, 1102, 1103]
    hits = sum(len(set(np.argsort(((x - x[q]) ** 2).sum(1))[1:11]) & set(got[q])) for q in (0, 100, 200))
    assert all(len(got[q]) == 10 for q in (0, 100, 200)) and hits >= 27


def test_neighbours_of_isolated_vectors(spark):
    """Few large clusters and some isolated vectors: each query gets its rows and its neighbours, not only the mean."""
    from ledgerlens.llm import ann
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 32))
    x = np.concatenate([centres[i % 3] + 0.05 * rng.normal(size=(1, 32)) for i in range(4500)] + [rng.normal(size=(60, 32))])
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "vec_id long, embedding array<double>")
    asked = [*range(0, 4500, 50), *range(4500, 4560, 8)]
    got = defaultdict(list)
    for r in ann.search(df, lambda i: i.isin(asked)).collect():
        got[r.query_id].append(r.vec_id)
    hits = {q: len(set(np.argsort(((x - x[q]) ** 2).sum(1))[1:11]) & set(got[q])) for q in asked}
    assert all(len(got[q]) == 10 for q in asked)
    assert min(hits[q] for q in asked if q >= 4500) >= 7 and sum(hits.values()) >= 9 * len(asked)


def test_url_filter_follows_every_link(spark):
    """Canonical links beside refreshes, several of each, relative targets and character references."""
    from html import unescape
    from urllib.parse import urljoin

    from ledgerlens.llm.url_filter import filter_urls
    own = '<link rel="canonical" href="http://p.net/d/{}"/>'
    refresh = '<meta http-equiv="refresh" content="{}">'
    heads = [own + refresh.format("0; url=http://x.com/de/a"), refresh.format("3;URL='http://x.com/de/b'") + own,
             own + '<link href="http://x.com/de/c" rel="alternate canonical">', '<link rel=canonical href="bad">',
             '<link rel="canonical" href="../d/./bad">', '<link rel="canonical" href="/q?a=1&amp;b=2">',
             '<link rel="canonical" href="?a=1&#38;c=3">', own + own.replace("http://p.net/d/{}", "http://x.com/de/e"),
             own, '<link rel="canonical" href="/ok?u=http://x.com/de/a">', '<link rel="stylesheet" href="http://x.com/de/a">',
             refresh.format("5"), '<link rel="canonical" href="#top">', '<link rel="canonical" href="mailto:a@x.com">']
    rows = [(i, f"http://p.net/d/{i}", h.replace("{}", str(i))) for i, h in enumerate(heads)]
    rows += [(90, "http://p.net/d/bad", '<link rel="canonical" href="http://x.com/de/z">'),
             (91, "http://p.net/q?a=1&b=2", refresh.format("0;url=http://x.com/de/z")),
             (92, "http://p.net/d/6?a=1&c=3", refresh.format("0;url=http://x.com/de/z"))]
    got = {r.page_id: r.verdict for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [i for i in got if got[i] == "block"] and {i for i in got if got[i] == "block"} == {0, 1, 2, 3, 4, 5, 6, 7, 90, 91, 92}
    assert urljoin(rows[4][1], "../d/./bad") == rows[-3][1] and urljoin(rows[5][1], unescape("/q?a=1&amp;b=2")) == rows[-2][1]


def test_line_dedup_tells_rows_apart(spark):
    """Rows without id, or with the same one, are documents of their own; of equal rows one keeps its lines."""
    from ledgerlens.llm.line_dedup import dedup_lines
    texts = ["l1\nl2\nl3\nkeep A", "u1\nu2\nu3\nu4", "q\nl1\nl2\nl3"]
    for doc_id in (None, 5):
        df = spark.createDataFrame([(doc_id, t) for t in texts], "doc_id long, text string").coalesce(1)
        for name in ("row", "of", "gone", "Row_"):
            df = df.withColumn(name, df.doc_id)
        got = {r.text: r.n_removed for r in dedup_lines(df).collect()}
        assert got == {"l1\nl2\nl3\nkeep A": 0, "u1\nu2\nu3\nu4": 0, "q": 3}
    same = spark.createDataFrame([(7, texts[0])] * 4, "doc_id long, text string")
    assert sorted(r.n_removed for r in dedup_lines(same).collect()) == [0, 4, 4, 4]


def test_small_tables_are_hashed(spark, monkeypatch):
    """Tables of 500 and 2,000 vectors go through the buckets, and every query finds nine of ten neighbours."""
    from ledgerlens.llm import ann
    calls = []
    round_, fit = ann._round, ann._fit_probes
    monkeypatch.setattr(ann, "_round", lambda pool, due, hasher, k: calls.append(hasher.buckets) or round_(pool, due, hasher, k))
    monkeypatch.setattr(ann, "_fit_probes", lambda *a: calls.append("fit") or fit(*a))
    for sf in ("sf0.01", "sf0.1"):
        df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
        calls.clear()
        got = defaultdict(list)
        for r in ann.search(df, lambda i: i % 100 == 0).collect():
            got[r.query_id].append(r.vec_id)
        assert "fit" in calls and 6 * 128 in calls
        rows = df.orderBy("vec_id").collect()
        x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
        for q in [i for i in ids if i % 100 == 0]:
            d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
            d[ids == q] = np.inf
            assert len(got[q]) == 10 and len(set(ids[np.lexsort((ids, d))[:10]]) & set(got[q])) >= 9


def test_equal_texts_have_equal_quality(spark):
    """Long equal texts in one column: equal means, whatever part of a batch they fall in; means are plain averages."""
    import pyarrow as pa
    from ledgerlens.llm import quality
    rng = np.random.default_rng(3)
    vectors = np.rint(rng.normal(size=(quality.UNITS, quality.DIM)) * quality.GRAIN).astype(np.int32)
    text = " ".join(f"Word{i}" for i in rng.integers(0, 500, 1500))
    x = quality.pool(pa.array([text] * 300 + ["", "two words"]), vectors)
    assert len(np.unique(x[:300], axis=0)) == 1 and not x[300].any()
    word, shape, first = quality.units(pa.array([text]))
    v = vectors / quality.GRAIN
    assert np.allclose(x[0], np.concatenate([v[word].mean(0), v[shape].mean(0)]))


def test_quality_contexts_and_network_against_plain_loops():
    import pyarrow as pa
    from ledgerlens.llm import quality
    texts = ["a b c d a b", "", "one", "b a B c!"]
    index = quality.index_vectors()
    total = np.zeros((quality.UNITS + 1, quality.DIM))
    quality.add_contexts(total, index, *quality.units(pa.array(texts)))
    want = np.zeros_like(total)
    for t in texts:
        word, shape, _ = quality.units(pa.array([t]))
        for i in range(len(word)):
            for j in range(max(0, i - 2), min(len(word), i + 3)):
                if j != i:
                    for unit in (word[i], shape[i]):
                        want[unit] += index[word[j]] + index[shape[j]]
    assert np.array_equal(total[:quality.UNITS], want[:quality.UNITS])
    rng = np.random.default_rng(0)
    net = {"mean": rng.normal(size=4), "scale": rng.random(4) + 0.5, "w1": rng.normal(size=(4, 3)), "b1": rng.normal(size=3),
           "w2": rng.normal(size=3), "b2": 0.3, "temperature": 1.7}
    x = rng.normal(size=(5, 4))
    for row, p in zip(x, quality.probability(net, x)):
        hidden = [max(0.0, sum((row[i] - net["mean"][i]) / net["scale"][i] * net["w1"][i][j] for i in range(4)) + net["b1"][j]) for j in range(3)]
        s = sum(h * w for h, w in zip(hidden, net["w2"])) + net["b2"]
        assert p == pytest.approx(1 / (1 + np.exp(-s / 1.7)))


def test_decoding_of_ids_that_no_text_has(spark):
    from ledgerlens.llm import pieces
    model = pieces.load_pieces(pieces.default_model())
    codec = pieces.Codec(model)
    ids = list(np.frombuffer(codec.encode("The cat"), np.int32))
    inner = next(i for i, (p, _, k) in enumerate(model["pieces"]) if k == "n" and p == "ing")
    byte = codec.byte[0xC3]
    rows = [(0, [int(i) for i in ids]), (1, [inner]), (2, [10 ** 9, -4, inner]), (3, [None, inner]), (4, [byte, inner]), (5, []), (6, None)]
    got = {r.k: r.decoded for r in pieces.decode(spark.createDataFrame(rows, "k int, ids array<int>"), pieces.share(spark)).collect()}
    assert got == {0: "The cat", 1: "ing", 2: "\ufffd\ufffding", 3: "\ufffding", 4: "\ufffding", 5: "", 6: None}


def test_toxicity_equals_plain_ftrl(spark):
    """Whole operator against features by regular expressions and per-coordinate FTRL in plain Python."""
    import math

    from ledgerlens.llm import toxicity
    from ledgerlens.llm import words as wd
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(40)] + ["scum", "vile"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 25))) for _ in range(150)]
    texts += [None, "", "Scum, SCUM!  scum", "é-é vile"]
    toxic = [int(t is not None and ("scum" in t.lower() or "vile" in t)) for t in texts]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, epochs=3, l1=0.5)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}

    mask = (1 << 64) - 1

    def hashed(word):
        body = np.frombuffer(word.encode(), np.uint8)
        return int(wd.hash_spans(body, np.array([0]), np.array([len(body)]), lower=True)[0])

    def mixed(x):
        return int(wd.mix64(np.array([x & mask], np.uint64))[0])

    def buckets(text):
        ws = [hashed(w) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")]
        h = list(ws)
        for gap, salt in ((1, 0x51ED270B), (2, 0xA24BAED4)):
            h += [mixed(a * 0x9E3779B97F4A7C15 + b + salt) for a, b in zip(ws, ws[gap:])]
        return sorted({x >> 44 for x in h})
    from pyspark.sql import functions as F
    turn = {r.doc_id: r.t for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(7)).alias("t")).collect()}
    fit = sorted((i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2), key=turn.get)
    z, n, zb, nb, alpha, beta, l1 = defaultdict(float), defaultdict(float), 0.0, 0.0, 2.0, 1.0, 0.5
    weight = lambda c: 0.0 if abs(z[c]) <= l1 else (math.copysign(l1, z[c]) - z[c]) / ((beta + math.sqrt(n[c])) / alpha)
    bias = lambda: -zb / ((beta + math.sqrt(nb)) / alpha)
    for _ in range(3):
        for i in fit:
            at = buckets(texts[i])
            w, wb = {c: weight(c) for c in at}, bias()
            g = 1 / (1 + math.exp(-(wb + sum(w.values())))) - toxic[i]
            for c in at:
                z[c] += g - (math.sqrt(n[c] + g * g) - math.sqrt(n[c])) / alpha * w[c]
                n[c] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * wb
            nb += g * g
    want = {c: weight(c) for c in list(z) if weight(c)}
    assert dict(zip(model["at"].tolist(), model["w"].tolist())) == pytest.approx(want) and model["bias"] == pytest.approx(bias())
    assert 0 < len(want) < len(z)                                  # L1 leaves few
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(bias() + sum(want.get(c, 0.0) for c in buckets(t))))))


def test_pieces_frequent_chunks_stay_known(monkeypatch):
    """Chunks that keep occurring are solved once, however many others pass; all ids of rows are spelled at once."""
    from ledgerlens.llm import pieces
    monkeypatch.setattr(pieces, "CACHE", 40)
    codec = pieces.Codec(pieces.load_pieces(pieces.default_model()))
    solved, solve = [], codec.solve
    codec.solve = lambda chunk: solved.append(chunk) or solve(chunk)
    texts = [f"the cat of{i} word{i}  é▁{i}\n{i} " for i in range(200)]
    ids = [np.frombuffer(codec.encode(t), np.int32) for t in texts]
    assert solved.count(" the") == 1 and solved.count(" cat") == 1
    at = np.append(0, np.cumsum([len(i) for i in ids]))
    assert codec.decode_rows(np.concatenate(ids), at) == texts
    assert codec.decode([-1, len(codec.out)]) == "��" and codec.decode([]) == ""
