"""Scoring records: JSON payload parsing with coercion and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.normalize import coerce_amount, with_key
from ..schema import PAYLOAD_DEFAULTS, PAYLOAD_MAX_LENGTHS

# Numbers are read as text and coerced, so "12.5" and 12.5 both parse.
_WIRE_SCHEMA = T.StructType([
    T.StructField(c, T.StringType(), True)
    for c in ("description", "remarks", "debit", "credit", "posting_date", "reference")
])


def parse_payload(df: DataFrame, json_col: str = "payload", keep: list[str] | None = None
                  ) -> DataFrame:
    """JSON records → scoring frame: description, remarks, reference, debit,
    credit (bad → 0), posting_date (bad → null), with the record defaults."""
    rec = F.col("__rec")
    keep_cols = [F.col(c) for c in (keep or [])]

    def text(c: str) -> Column:
        default = PAYLOAD_DEFAULTS.get(c)
        v = rec[c]
        return v if default is None else F.coalesce(v, F.lit(default))

    parsed = (df.select(*keep_cols, F.from_json(F.col(json_col), _WIRE_SCHEMA).alias("__rec"))
              .select(*keep_cols,
                      text("description").alias("description"),
                      text("remarks").alias("remarks"),
                      text("reference").alias("reference"),
                      rec["debit"].alias("debit"), rec["credit"].alias("credit"),
                      F.try_to_timestamp(F.col("__rec.posting_date")).alias("posting_date")))
    return parsed.withColumns({c: coerce_amount(parsed, c) for c in ("debit", "credit")})


def read_payload(df: DataFrame, json_col: str = "payload") -> tuple[DataFrame, DataFrame]:
    """JSON records → (records to score, records set aside with their violations), each with a ``txn_id``."""
    return split_payload(with_key(parse_payload(df, json_col, keep=[c for c in df.columns if c == "txn_id"])))


def payload_violations(df: DataFrame) -> Column:
    """ARRAY<STRING> of constraint violations of a payload row (empty = valid)."""
    checks = [F.when(F.col("description").isNull(), F.lit("description_required"))]
    for c, limit in PAYLOAD_MAX_LENGTHS.items():
        checks.append(F.when(F.char_length(F.col(c)) > limit, F.lit(f"{c}_too_long")))
    return F.array_compact(F.array(*checks))


def split_payload(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) — one projection, two filters; no shuffle."""
    tagged = df.withColumn("violations", payload_violations(df))
    return (tagged.filter(F.size("violations") == 0).drop("violations"),
            tagged.filter(F.size("violations") > 0))
