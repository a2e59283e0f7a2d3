"""Corpus pipeline: toxicity, line dedup, near duplicates, source mixing, SentencePiece ids.

Every stage is ``f(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as
the next one's ``docs``.  All but the last return the columns of ``docs``.  The toxicity model learns from
texts and labels, which SQL cannot express, so there is no oracle; tests compare ``run`` with plain Python.

Nulls, empty and very long texts, repeated rows, empty tables and extra columns follow the operators' rules
(see their modules).  In particular: a null text is scored like an empty one and kept; the near-duplicate
stage keeps one row of each group (smallest id, rows without id last, then the first), and every row without text;
mixing repeats whole rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import jaccard, line_dedup, mixing, pieces, toxicity
from ledgerlens.llm.common import table, unused_names, written

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that score as toxic go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, "toxicity__").filter(F.col("toxicity__") < TOXIC_FROM).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: later occurrences of three-line windows go; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of linked documents the one with the smallest id stays.

    Rows are grouped by a key of their own, so documents that share an id, or have none, are told apart."""
    key, of, first = unused_names(docs, "row", "of", "first")
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-rows")
    groups = jaccard.jaccard_components(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(of), "component_id")
    ranked = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(key))
    stay = (rows.select(key, "doc_id").join(groups, F.col(key) == F.col(of)).groupBy("component_id")
            .agg(F.min(ranked).alias(first)).select(F.col(f"{first}.{key}").alias(of)))
    return rows.join(stay, F.col(key) == F.col(of), "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents as often as the mix takes them."""
    others = [c for c in docs.columns if c != "doc_id"]
    mixed = mixing.mix_sources(docs, keep=tuple(others))
    return (mixed.withColumn("time__", F.explode(F.array_repeat(F.lit(0), F.col("repeats").cast("int"))))
            .select(*[F.col("doc_id") if c == "doc_id" else F.col(f"kept_{c}").alias(c) for c in docs.columns]))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: ids of every document in the mix."""
    return (pieces.encode(docs.select("doc_id", "lang", "source", "text"), pieces.share(spark))
            .select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", to_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
