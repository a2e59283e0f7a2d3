"""Text cleaning and tokenisation against plain-Python formulations."""
import html
import re

from pyspark.sql import functions as F

from ledgerlens.functions import text as tx

_TAG = re.compile(r"<[^>]+>")
_BR = re.compile(r"<br\s*/?>", re.IGNORECASE)
_WS = re.compile(r"\s+")


def py_strip_html(raw):
    if not raw or raw == "NULL":
        return ""
    t = _TAG.sub(" ", _BR.sub(" ", html.unescape(raw)))
    return _WS.sub(" ", t).strip()


def py_normalize(t, accents=True):
    if not t:
        return ""
    t = _WS.sub(" ", t.lower())
    keep = r"[^a-z0-9àâäéèêëïîôùûüçœæ\s\-]" if accents else r"[^a-z0-9\s\-]"
    return _WS.sub(" ", re.sub(keep, " ", t)).strip()


def py_char_wb(text, lo=3, hi=5):
    out = []
    for w in text.split():
        w = f" {w} "
        for n in range(lo, hi + 1):
            off = 0
            out.append(w[off:off + n])
            while off + n < len(w):
                off += 1
                out.append(w[off:off + n])
            if off == 0:
                break
    return out


SAMPLES = ["<p>Hello&amp;lt; <BR/>World  é É &copy;x</p>", "NULL", "", "ab-cd  cœur",
           "PRLV SEPA CPY:FR12345678<br />LIB:REGLEMENT FACTURE", "a b\tc\nd",
           "&amp;amp; &quot;q&quot; x&middot;y &nbsp;z"]


def test_strip_html_and_normalize_match_python(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "t string")
    rows = df.select("t", tx.strip_html("t").alias("s"),
                     tx.normalize_text(tx.strip_html("t")).alias("n"),
                     tx.normalize_text("t", preserve_accents=False).alias("a")).collect()
    for r in rows:
        assert r["s"] == py_strip_html(r["t"])
        assert r["n"] == py_normalize(py_strip_html(r["t"]))
        assert r["a"] == py_normalize(r["t"], accents=False)


def test_pages_strip_html_whole_table(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    for r in pages.select("html", tx.strip_html("html").alias("s")).collect():
        assert r["s"] == py_strip_html(r["html"])


def test_documents_char_and_word_grams(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    norm = docs.select(tx.normalize_text("text").alias("n"))
    out = norm.select("n", tx.char_wb_ngrams("n").alias("c"),
                      tx.word_tokens(tx.strip_accents("n")).alias("tok")) \
              .select("n", "c", "tok", tx.word_ngrams("tok").alias("w")).collect()
    tok_re = re.compile(r"(?u)\b\w\w+\b")
    for r in out:
        assert sorted(r["c"]) == sorted(py_char_wb(r["n"]))
        toks = tok_re.findall(r["n"].translate(str.maketrans("àâäéèêëïîôùûüç", "aaaeeeeiiouuuc")))
        assert r["tok"] == toks
        assert r["w"] == toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]


def test_char_grams_edge_words(spark):
    texts = ["a", "ab", "abc", "abcdef", " x  yz ", "", "é œuf"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, got in zip(texts, [r[0] for r in df.select(tx.char_wb_ngrams("t")).collect()]):
        assert sorted(got) == sorted(py_char_wb(t))


def test_clean_for_extraction_keeps_tags(spark):
    df = spark.createDataFrame([("NBE:Jean&nbsp;Dupont<br />LIB:X",), ("nan",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.clean_for_extraction("t")).collect()]
    assert got == ["NBE:Jean Dupont<br />LIB:X", "", ""]


def test_entities_as_the_standard_library(spark):
    import html
    from ledgerlens.functions.text import decode_entities
    texts = ["R&eacute;glement &euro; 5 &#233;", "&ltimes; &lt &ltx &lt;b&gt;", "&amp;amp; &amp", "&#0; &#128; &#x80; &#xD800; &#1114112;",
             "&#x1F600; &#99999999999999; &#xfffffffffff; &#11; &#xFFFE; &#xFDD0;", "&notit; &notin; &unknown; & &&", "&", "", "plain", "&#; &#x; &#xZ;",
             "&CounterClockwiseContourIntegral; &eacutex &EACUTE;", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", decode_entities("t").alias("d")).collect()
    assert {r["i"]: r["d"] for r in rows} == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}


def test_broken_pages_as_the_html_parser_reads_them(spark):
    """Unclosed tags, comments and quotes: the text the standard library's parser gives for what the tag patterns
    leave."""
    import html
    import re
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.got = []

        def handle_data(self, data):
            self.got.append(data)
    pages = ["a < b and c", "x <b", "x <b class='d", "m <> n", "open <!-- comment", "end </b", "a <b>bold</b> <i", "q <? p", "a <b <c",
             "<", "a<", "<<b>>", "5 &lt; 6 &amp;amp; <b", "caf&eacute; &amp;eacute; <b", "x &amp;#233; <", "fine &amp;amp; closed <p>",
             "l1<br/>l2 <br", "a <![CDATA[x", "1 &amp;lt b <c", "&amp;copy <u", "t <script x", "no tags &amp; no sign", "<a title='1 > 0'> &amp;gt; <"]
    rows = spark.createDataFrame(list(enumerate(pages)), "k int, page string")
    got = {r.k: r.t for r in rows.select("k", tx.strip_html("page").alias("t")).collect()}
    for k, page in enumerate(pages):
        text = re.sub(r"<[^>]+>", " ", re.sub(r"(?i)<br\s*/?>", " ", html.unescape(page)))
        if "<" in text:
            p = Text()
            p.feed(text)
            p.close()
            text = "".join(p.got)
        assert got[k] == re.sub(r"\s+", " ", text).strip(), page


def test_vocabulary_by_summaries(spark):
    """The same vocabulary as the full count, whether the summaries suffice or a block must be counted in full."""
    import random

    from ledgerlens.operators import tfidf as tf
    rng = random.Random(4)
    ws = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(ws, [1 / (i + 1) for i in range(400)], k=rng.randrange(0, 30))) for _ in range(600)]
    df = spark.createDataFrame([(i, t, t and t[:20]) for i, t in enumerate(texts + ["", None])], "doc_id long, a string, b string").repartition(6)
    blocks = (tf.BlockSpec("a", 30, (1, 2), min_df=2, max_df=0.5), tf.BlockSpec("b", 40, (3, 4), analyzer="char_wb", max_df=None, strip_accents=False))
    want = tf.TfidfVectorizer(blocks).fit(df)
    rows = lambda m: sorted(tuple(r) for r in m.vocab.collect())
    for counters, full in ((100_000, []), (300, None), (3, ["a", "b"])):
        v = tf.TfidfVectorizer(blocks, counters=counters)
        m = v.fit(df)
        assert rows(m) == rows(want) and m.sizes == want.sizes
        assert full is None or v.counted_in_full == full
    n = sum(c for c in (tf.summaries(df, blocks, 50).groupBy("block").count().rdd.map(lambda r: r["count"]).collect()))
    assert n <= 6 * 2 * 101                                        # what is exchanged is bounded by the counters


def test_batch_counts():
    import pyarrow as pa

    from ledgerlens.operators.tfidf import batch_counts
    terms, df, cf = batch_counts(pa.array([["a", "b", "a"], [], None, ["b"]], pa.list_(pa.string())).slice(0))
    assert dict(zip(terms.to_pylist(), zip(df.tolist(), cf.tolist()))) == {"a": (1, 2), "b": (2, 2)}
    terms, df, cf = batch_counts(pa.array([["z"], ["a"], ["a", "a"]]).slice(1))
    assert dict(zip(terms.to_pylist(), zip(df.tolist(), cf.tolist())))["a"] == (2, 3)
    assert len(batch_counts(pa.array([[], None], pa.list_(pa.string())))[0]) == 0
