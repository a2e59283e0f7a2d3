"""Line dedup (operator 8): overlapping windows of three lines, with DataFrame functions only.

A text is cut at line feeds.  Each run of three consecutive lines is a window, known by two hashes of its
lines (96 bits).  Of the windows that occur more than once anywhere, the first occurrence (smallest doc_id,
then place of the row in the input, then position) stays; the lines that the later occurrences cover, merged, are
removed.  Every row gets a key of its own in a written table, so rows are told apart whatever their ids.

Windows are counted by a partial aggregate, so a window that a third of all documents share reaches the
shuffle as one row per task.  Only repeated windows go back to their rows, by a join that adaptive execution
splits when a window is hot.  Texts are shuffled once, to meet the removed positions of their document.

Null text: no line, stays null.  Fewer than three lines (the empty text has one): nothing to compare, stays.
Rows that share a doc_id, or have none, are documents of their own: a text keeps what is repeated nowhere else,
and of equal rows one keeps its lines.  Null doc_id sorts first.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import let, table, unused_names, written


def line_windows(docs: DataFrame, key: str, width: int = 3) -> DataFrame:
    """(doc_id, k, pos, w1, w2) of every window; k is the row's key."""
    def hashes(lines):
        n = F.size(lines) - (width - 1)
        runs = [F.slice(lines, F.lit(i + 1), n) for i in range(width)]
        return F.when(n < 1, F.array().cast("array<struct<w1:bigint,w2:int>>")).otherwise(
            F.transform(F.arrays_zip(*[r.alias(f"l{i}") for i, r in enumerate(runs)]),
                        lambda z: F.struct(F.xxhash64(z).alias("w1"), F.hash(z).alias("w2"))))
    split = F.split(F.col("text"), "\n", -1)
    return (docs.filter(F.col("text").isNotNull())
            .select("doc_id", F.col(key).alias("k"), F.posexplode(let(split, hashes)).alias("pos", "w"))
            .select("doc_id", "k", "pos", "w.w1", "w.w2"))


def dedup_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with ``text`` replaced by its kept lines, plus n_lines and n_removed (in place of columns of
    these names)."""
    key, of, gone = unused_names(docs, "row", "of", "gone")
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "line-rows")
    windows = line_windows(rows, key, width)
    first = (windows.groupBy("w1", "w2")
             .agg(F.min(F.struct("doc_id", "k", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select(F.col("w1").alias("v1"), F.col("w2").alias("v2"), F.col("first.k").alias("fk"),
                                     F.col("first.pos").alias("fpos")))
    later = (windows.drop("doc_id").join(first, (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2")))
             .filter((F.col("k") != F.col("fk")) | (F.col("pos") != F.col("fpos"))))
    covered = (later.groupBy(F.col("k").alias(of))
               .agg(F.sort_array(F.collect_set("pos")).alias("at"))
               .select(of, F.array_distinct(F.flatten(F.transform(
                   "at", lambda p: F.sequence(p, p + (width - 1))))).alias(gone)))
    lines = F.split(F.col("text"), "\n", -1)
    n = F.coalesce(F.size(lines), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(n)
    kept = let(lines, lambda ls: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(gone)), lambda i: F.get(ls, i)), "\n"))
    out = rows.join(covered, F.col(key) == F.col(of), "left")
    return out.select(*[(F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)).alias("text") if c == "text"
                        else rows[c] for c in docs.columns if c not in ("n_lines", "n_removed")],
                      n.cast("long").alias("n_lines"),
                      F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_removed",
        F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, k, ls, unnest(range(0, len(ls) - 2)) AS pos FROM d WHERE text IS NOT NULL),
w AS (SELECT doc_id, k, pos, ls[pos + 1] AS a, ls[pos + 2] AS b, ls[pos + 3] AS c FROM p),
r AS (SELECT k, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS FIRST, k, pos) AS turn FROM w),
g AS (SELECT DISTINCT k, pos + o AS ix FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE turn > 1),
l AS (SELECT k, unnest(ls) AS line, unnest(range(0, len(ls))) AS ix FROM d WHERE text IS NOT NULL),
s AS (SELECT l.k, count(*) AS n_lines, count(g.ix) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY l.ix) FILTER (WHERE g.ix IS NULL), '') AS kept
    FROM l LEFT JOIN g ON l.k = g.k AND l.ix = g.ix GROUP BY l.k)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
    sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON d.k = s.k
"""
