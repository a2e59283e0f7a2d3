"""File and table scans of raw ledgers (all-string, coerced later)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import NA_TOKENS


def map_na_tokens(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn the default NA tokens of a pandas CSV read into nulls.

    Spark's CSV ``nullValue`` accepts one token, so the whole set is mapped
    with one projection (narrow, no shuffle)."""
    cols = set(columns or df.columns)
    tokens = list(NA_TOKENS)

    def na(c: str) -> Column:
        return F.when(F.col(c).isin(tokens), F.lit(None).cast("string")).otherwise(F.col(c))

    return df.select(*[na(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV read with every column as STRING (no inference) and NA tokens as null."""
    try:
        raw = (spark.read.option("header", True).option("inferSchema", False)
               .option("mode", "PERMISSIVE").csv(path))
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err) or "does not exist" in str(err):
            raise FileNotFoundError(f"Data file not found: {path}") from err
        raise
    return map_na_tokens(raw)


def read_csv_ledger(spark: SparkSession, path: str, target_length: int = 6,
                    min_class_samples: int | None = None) -> DataFrame:
    """CSV ledger → keyed, normalised and checked ledger."""
    from ..operators.normalize import load_ledger
    return load_ledger(read_csv_strings(spark, path), target_length, min_class_samples)


def read_table_ledger(spark: SparkSession, name_or_path: str, fmt: str | None = None,
                      target_length: int = 6,
                      min_class_samples: int | None = None) -> DataFrame:
    """Catalog table, Parquet or ORC ledger → keyed, normalised and checked ledger."""
    from ..operators.normalize import load_ledger
    if fmt is None:
        raw = spark.read.table(name_or_path)
    else:
        raw = spark.read.format(fmt).load(name_or_path)
    return load_ledger(raw, target_length, min_class_samples)
