"""The ledger of the model queries is built once, and its texts are cleaned in one pass."""

from pyspark.sql import functions as F

from ledgerlens.functions import text as tx
from ledgerlens.operators import tfidf as tf
from ledgerlens.plans import catalog

ODD = [None, "", "NULL", "null", " ", "plain", "A-b--C  d", "éÈ œuvre ß İ Σ", "a\t b\x1cc", "x &amp; y", "a < b<br>c", "1 &lt; 2 &amp;amp; <b>z",
       "<br />", "<BR/>top", "<p class='x'>t</p>", "a<", "&eacute;t&eacute;", "&#233;&#x20AC;&unknown;", "nan", "a <b", "…a…", "日本 x", "😀".encode("utf-16", "surrogatepass").decode("utf-16") + "y"]


def by_replacing(col, keep):
    """C2 as it is defined: other characters become spaces, runs of spaces one, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), f"[^{keep}\\-]", " "), " +", " "))


def test_one_pass_cleaning_equals_the_steps(spark):
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(ODD)], "txn_id int, description string, remarks string")
    keep = "a-z0-9" + tx.ACCENTED_LETTERS
    rows = df.select("remarks", tx.normalize_html("remarks").alias("got"), by_replacing(tx.strip_html("remarks"), keep).alias("want"),
                     tx.normalize_text("remarks").alias("text"), by_replacing(F.col("remarks"), keep).alias("text_want"),
                     tx.normalize_text("remarks", False).alias("ascii"), by_replacing(F.col("remarks"), "a-z0-9").alias("ascii_want")).collect()
    for r in rows:
        assert (r["got"], r["text"], r["ascii"]) == (r["want"], r["text_want"], r["ascii_want"]), r["remarks"]
    cleaned = {r["doc_id"]: (r["desc"], r["rem"], r["chr"]) for r in tf.ledger_texts(df).collect()}
    assert cleaned[ODD.index("a < b<br>c")] == ("a b br c", "a b c", "a b br c a b c")
    assert cleaned[0] == ("", "", " ")


def test_boundary_is_searched_in_the_written_ledger(spark, tmp_path, monkeypatch):
    """The joins that build the ledger run once, not once for every pass of the search."""
    import datetime as dt
    day = dt.datetime(2020, 1, 1)
    orders = [(i, i % 3, "OFP"[i % 3], 100.0 + i, day + dt.timedelta(days=i % 7), "1-URGENT") for i in range(40)] + [(99, 1, "O", 5.0, None, "1-URGENT")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
                          "o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, f"C{i}", 0, 1.0, "AUTO") for i in range(3)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
                          "c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "F", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    sf, searched = str(tmp_path), []
    find = catalog.sp.find_boundary
    monkeypatch.setattr(catalog.sp, "find_boundary", lambda df, *a, **k: searched.append(df.inputFiles()) or find(df, *a, **k))
    tr, va = catalog.split_ledger(spark, sf)
    assert len(searched) == 1 and not any(f.startswith(("file:" + sf, "file://" + sf)) for f in searched[0])
    got = sorted((r["txn_id"], r["part"]) for r in tr.unionByName(va).select("txn_id", "part").collect())
    want = sorted((r["txn_id"], r["part"]) for r in catalog.labelled_ledger(spark, sf).select("txn_id", "part").collect())
    assert got == want and len(got) == 40 and sum(p == "train" for _, p in got) == 32
