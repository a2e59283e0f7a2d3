"""Mixing sources to target weights (operator 2): capped water-filling and seeded whole and fractional
repetitions, with DataFrame functions only.

Every source asks for ``share`` x (all words) in proportion to its weight.  A source stops at ``max_epochs``
times its own words; what it leaves is shared again by weight until no source is above its cap.  The fixed
point has a closed form: with sources ordered by cap / weight, the ones at their cap are a prefix.

Repetitions: every document of a source is taken floor(target / words) whole times, and a seeded part of
the documents once more.  That part is cut by a hash of the document id: per source the words of 4,096 hash
buckets are summed, and the buckets below the cut hold as many words as the fraction asks for (within half a
bucket).  No document order and no random generator is involved, so reruns agree.

Rows per source are never gathered: documents are pre-aggregated to at most 4,096 rows per source, and the
per-source plan (a row per source) is joined back by its measured size or by a skew-splittable join.

Null text: size 0.  Null source: a source of its own, ordered last.  Null or repeated ``doc_id``: hashed like
any other value, equal ids fall in one bucket and are repeated alike.  A source without words gets target 0.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD, written

BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_bucket(doc_id: Column, seed: int) -> Column:
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % BUCKETS


def source_targets(totals: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size) -> + weight, target.  One row per source, summed beforehand."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    size = F.col("source_size").cast("double")
    every = Window.partitionBy()
    upto = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, 0)
    t = (totals.withColumn("weight", weight)
         .withColumn("cap", size * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
         .withColumn("want", F.sum(size).over(every) * share)
         .withColumn("cap_upto", F.sum("cap").over(upto)).withColumn("w_upto", F.sum("weight").over(upto))
         .withColumn("w_all", F.sum("weight").over(every))
         # at its cap when filling all others to the same level would not need more than is wanted
         .withColumn("full", F.col("cap_upto") + F.col("ratio") * (F.col("w_all") - F.col("w_upto")) <= F.col("want"))
         .withColumn("left", F.col("want") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every))
         .withColumn("w_left", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)))
    target = F.when(F.col("full") | (F.col("w_left") == 0), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.try_divide(F.col("left") * F.col("weight"), F.col("w_left"))))
    return t.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5,
                max_epochs: float = 2.0, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source), repeats, taken; ``keep`` names
    further columns of ``docs`` to carry."""
    carried = [F.col(c).alias(f"kept_{c}") for c in keep]
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                        hash_bucket(F.col("doc_id"), seed).alias("bucket"), *carried)
    narrow = sizes if keep else written(sizes, "mix-sizes")
    hist = written(narrow.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-hist")
    plan = source_targets(hist.groupBy("source").agg(F.sum("words").alias("source_size")),
                          weights, share, max_epochs)
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("upto", F.sum("words").over(by_bucket))
    cut = (cum.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
           # the bucket that crosses the need counts if that brings the sum closer
           .filter(F.col("upto") - F.col("words") / F.lit(2.0) <= F.col("need"))
           .groupBy("s").agg(F.max(F.when(F.col("need") > 0, F.col("bucket"))).alias("cut")))
    final = written(plan.withColumnRenamed("source", "s0").join(cut, F.col("s0").eqNullSafe(F.col("s")), "left")
                    .select("s0", "source_size", "target", "whole", "cut"), "mix-plan")
    repeats = F.col("whole") + (F.col("bucket") <= F.coalesce(F.col("cut"), F.lit(-1))).cast("long")
    return (narrow.join(final, F.col("source").eqNullSafe(F.col("s0")))
            .select("doc_id", "size", "source_size", "target", repeats.alias("repeats"),
                    (F.col("size") * repeats).alias("taken"), *[F.col(f"kept_{c}") for c in keep]))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    from ledgerlens.llm.common import table
    return mix_sources(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 4096 AS bucket FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
    2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS want,
    sum(weight) OVER () AS w_all FROM w),
u AS (SELECT *, sum(cap) OVER o AS cap_upto, sum(weight) OVER o AS w_upto FROM r
    WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, cap_upto + ratio * (w_all - w_upto) <= want AS is_full FROM u),
l AS (SELECT *, want - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS rest,
    sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS w_rest FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full OR w_rest = 0 THEN cap
    ELSE least(cap, rest * weight / w_rest) END::DOUBLE AS target FROM l),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS whole FROM t),
n AS (SELECT *, target - whole * source_size AS need FROM p),
h AS (SELECT source, bucket, sum(size) AS words FROM d GROUP BY ALL),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto FROM h),
cut AS (SELECT n.source, max(CASE WHEN need > 0 THEN bucket END) AS cut FROM c JOIN n
    ON c.source IS NOT DISTINCT FROM n.source WHERE upto - words / 2.0 <= need GROUP BY n.source)
SELECT doc_id, size, source_size, target,
    whole + (bucket <= coalesce(cut, -1))::BIGINT AS repeats,
    size * (whole + (bucket <= coalesce(cut, -1))::BIGINT) AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN cut ON n.source IS NOT DISTINCT FROM cut.source
"""
