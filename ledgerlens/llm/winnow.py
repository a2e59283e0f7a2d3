"""Document fingerprints (operator 9): winnowing, with DataFrame functions only.

The units are words.  Each run of ``k`` words is a gram with a 64-bit hash; of each window of ``w`` grams the
smallest hash is chosen, the rightmost one on ties, and kept with its position.  Any run of w + k - 1 words
that two texts share therefore puts a common hash into both fingerprints.  Hashes are compared by their top
34 bits joined to the reversed position in one long, which makes "smallest, then rightmost" a plain minimum.

A text of fewer than ``k`` words is one gram; without words the fingerprint is empty.  Likeness is the
Jaccard similarity of the distinct hashes, and 1 for two empty fingerprints.  Null text counts as empty.

The neighbour in descending doc_id comes from a range-partitioned table of ids alone: a window per range,
and a table of one row per range for the borders.  Rows that share a doc_id have the same next document; if
that one is repeated, its smallest text is taken.  Null doc_id comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import let, table, written

K, W = 5, 16
_POS = (1 << 30) - 1


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """array<struct<pos: int, hash: bigint>> of a non-null text, by position."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")

    def grams(h: Column) -> Column:
        return (F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
                .when(F.size(h) < k, F.array(F.xxhash64(h)))
                .otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - k),
                                       lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))))

    def chosen(g: Column) -> Column:
        packed = F.transform(g, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 30), 30).bitwiseOR(_POS - i))
        low = let(packed, lambda p: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(p) - (w - 1), F.lit(1))), lambda i: F.array_min(F.slice(p, i, w))))
        return F.when(F.size(g) == 0, F.array().cast("array<struct<pos:int,hash:bigint>>")).otherwise(
            F.transform(F.array_distinct(low), lambda p: let(
                (_POS - p.bitwiseAND(_POS)).cast("int"), lambda at: F.struct(at.alias("pos"), F.get(g, at).alias("hash")))))

    return let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: let(grams(h), chosen))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def printed(pos: Column, hashed: Column) -> Column:
    return F.array_join(F.zip_with(pos, hashed, lambda p, h: F.concat(p.cast("string"), F.lit(":"), F.hex(h))), " ")


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, need): the next id in descending order (after the last, the first), and half the
    characters of the document's longest text."""
    ids = docs.groupBy("doc_id").agg(
        F.max(F.floor(F.char_length(F.coalesce("text", F.lit(""))) / 2)).cast("int").alias("need"))
    ranged = written(ids.repartitionByRange(F.col("doc_id").desc_nulls_last())
                     .withColumn("part", F.spark_partition_id()), "winnow-ids")
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last())
    heads = (ranged.groupBy("part").agg(F.max("doc_id").alias("head"))
             .select("part", F.when(F.lead("part").over(Window.orderBy("part")).isNull(), F.first("head").over(
                 Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
                 .otherwise(F.lead("head").over(Window.orderBy("part"))).alias("beyond")))
    last = F.lead("part").over(inside).isNull()
    return (ranged.withColumns({"follow": F.lead("doc_id").over(inside), "last": last}).join(heads, "part")
            .select("doc_id", F.when(F.col("last"), F.col("beyond")).otherwise(F.col("follow")).alias("next_id"), "need"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, with likenesses (see the op9 contract).

    A fingerprint travels as one plain array, positions then hashes (a third of the bytes of an array of
    structs), and the id as (value or 0, is null).  So both joins read one exchange of the texts, and one
    partitioning serves the aggregate and both joins."""
    key = lambda c, *names: (F.coalesce(c, F.lit(0)).alias(names[0]), c.isNull().alias(names[1]))
    doc = F.col("doc_id").cast("long")
    flat = let(fingerprint(F.col("text")), lambda p: F.concat(
        F.transform(p, lambda x: x["pos"].cast("long")), F.transform(p, lambda x: x["hash"])))
    full = docs.select(*key(doc, "k", "no"), F.coalesce("text", F.lit("")).alias("text")).withColumn("flat", flat)
    chain = written(next_ids(docs.select(doc.alias("doc_id"), "text")), "winnow-next")
    donor = chain.select(*key(F.col("next_id"), "k", "no"), *key(F.col("doc_id"), "pk", "pno"), "need")
    count = F.floor(F.size("flat") / 2).cast("int")
    pos, hashed = F.slice("flat", F.lit(1), count), F.slice("flat", count + 1, count)
    gift = (full.join(donor, ["k", "no"])
            .groupBy("pk", "pno").agg(F.min(F.struct(F.col("text").substr(F.lit(1), F.col("need")).alias("part"),
                                                     F.array_distinct(hashed).alias("own"))).alias("gift"))
            .withColumnsRenamed({"pk": "k", "pno": "no"}))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("gift.part").substr(F.lit(1), half))
    return (full.join(gift, ["k", "no"], "left")
            .select(F.when(~F.col("no"), F.col("k")).alias("doc_id"), n.cast("long").alias("n_chars"), edited.alias("edited"),
                    pos.alias("pos"), hashed.alias("hash"), F.col("gift.own").alias("next_own"))
            .withColumn("own", F.array_distinct("hash")).withColumn("edited_prints", fingerprint(F.col("edited")))
            .select("doc_id", "n_chars", "edited", "pos", "hash", F.col("edited_prints.pos").alias("edited_pos"),
                    F.col("edited_prints.hash").alias("edited_hash"),
                    likeness(F.col("own"), F.array_distinct("edited_prints.hash")).alias("near_edited"),
                    likeness(F.col("own"), F.col("next_own")).alias("near_next")))


def op9_winnowing(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("pos"), F.col("hash")).alias("fingerprint"),
        printed(F.col("edited_pos"), F.col("edited_hash")).alias("edited_fingerprint"), "near_edited", "near_next")
