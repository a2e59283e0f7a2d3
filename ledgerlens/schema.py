"""Schemas and fixed tokens of the ledger data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values (must equal the original pipeline's behaviour):
# the upstream sentinel for a missing value ...
NULL_SENTINEL = "NULL"
# ... and the tokens pandas' CSV reader turns into missing values by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

REQUIRED_COLUMNS = (
    "debit", "credit", "posting_date", "account_code",
    "description", "remarks", "reference",
)
TEXT_COLUMNS = ("description", "remarks", "reference")

# Normalised ledger.  ``txn_id`` is ours: Spark has no row order, so a stable
# key is needed for ties, joins back and comparison.
LEDGER_SCHEMA = T.StructType([
    T.StructField("txn_id", T.LongType(), False),
    T.StructField("account_code", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("remarks", T.StringType(), True),
    T.StructField("reference", T.StringType(), True),
    T.StructField("debit", T.DoubleType(), True),
    T.StructField("credit", T.DoubleType(), True),
    T.StructField("posting_date", T.TimestampType(), True),
])

# Raw files are read all-string; types are coerced, never inferred.
RAW_LEDGER_SCHEMA = T.StructType(
    [T.StructField("txn_id", T.StringType(), True)]
    + [T.StructField(c, T.StringType(), True) for c in (
        "account_code", "description", "remarks", "reference",
        "debit", "credit", "posting_date")]
)

# A scoring record: the ledger without the account code.
PAYLOAD_SCHEMA = T.StructType([
    T.StructField("description", T.StringType(), True),
    T.StructField("remarks", T.StringType(), True),
    T.StructField("debit", T.DoubleType(), True),
    T.StructField("credit", T.DoubleType(), True),
    T.StructField("posting_date", T.StringType(), True),
    T.StructField("reference", T.StringType(), True),
])

# Payload length limits and defaults.
PAYLOAD_MAX_LENGTHS = {"description": 1000, "remarks": 5000, "reference": 200}
PAYLOAD_DEFAULTS = {"remarks": "", "debit": 0.0, "credit": 0.0,
                    "posting_date": "", "reference": ""}

SCORED_CODE = T.StructType([
    T.StructField("code", T.StringType(), True),
    T.StructField("confidence", T.DoubleType(), True),
])
