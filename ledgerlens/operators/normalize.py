"""Ledger normalisation (P1-P12) and class-membership filters.

``prepare_ledger`` is narrow: projections and, if asked for, one broadcast
semi-join against per-class counts (which are computed at once).  The eager guards of the original
pipeline (all-zero amounts, empty result) are one aggregate in
``validate_ledger`` so a job runs them once, not per step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import REQUIRED_COLUMNS, TEXT_COLUMNS
from ..session import written


NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Class tables up to this many rows are broadcast; their size is counted first.
BROADCAST_CLASSES = 100_000


def check_required_columns(df: DataFrame) -> None:
    """Raise when a required column is absent, listing absent and present."""
    absent = sorted(set(REQUIRED_COLUMNS) - set(df.columns))
    if absent:
        raise ValueError(f"a ledger needs the columns {', '.join(absent)}; this one has {', '.join(sorted(df.columns))}")


def coerce_amount(df: DataFrame, col: str) -> Column:
    """To DOUBLE; missing, unparseable or not finite → 0.

    Only plain decimal and exponent notation counts as a number: the cast itself would also take type
    suffixes (``12d``) and the names of special values."""
    c = F.col(col)
    if isinstance(df.schema[col].dataType, T.StringType):
        c = F.when(F.trim(c).rlike(NUMBER), F.trim(c).try_cast("double"))
    else:
        c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0)))


#: Day patterns tried for text that is not ISO, in order.
DATE_FORMATS = ("dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd", "yyyyMMdd")


def coerce_date(df: DataFrame, col: str, date_format: str | list | None = None) -> Column:
    """To TIMESTAMP_NTZ, unparseable → null.  Text is an ISO date or date-time (None), in ``date_format``, or in
    the first of several formats that reads it."""
    dtype = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dtype, T.StringType):
        given = F.trim(c)
        formats = date_format if isinstance(date_format, (list, tuple)) else [date_format]
        parsed = [F.try_to_timestamp(given) if f is None else F.try_to_timestamp(given, F.lit(f)) for f in formats]
        return F.coalesce(*parsed).cast("timestamp_ntz")
    if isinstance(dtype, T.TimestampNTZType):
        return c
    return c.cast("timestamp_ntz")


def infer_date_formats(df: DataFrame, col: str = "posting_date") -> list:
    """The formats of a text column in the order in which they are tried, from one aggregate: the one that reads most
    rows first, then by rows read (ties: ISO, then the order of ``DATE_FORMATS``); those that read none are left out.
    So a day that two formats could read is taken as most of the column is written."""
    if not isinstance(df.schema[col].dataType, T.StringType):
        return [None]
    formats = [None, *DATE_FORMATS]
    read = df.agg(*[F.count(coerce_date(df, col, f)).alias(str(i)) for i, f in enumerate(formats)]).first()
    order = sorted((i for i in range(len(formats)) if read[i]), key=lambda i: (-read[i], i))
    return [formats[i] for i in order] or [None]


def with_key(df: DataFrame, key: str = "txn_id") -> DataFrame:
    """Add a stable key to rows that have none: a hash of the content and the ordinal among equal rows.

    Equal rows are counted by a partial aggregate, so a row repeated very often moves as one row per task,
    and dealt out again in runs of at most 1,000."""
    if key in df.columns:
        return df
    cols = df.columns
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    runs = counted.withColumn("__run", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / 1000))))
    width = F.least(F.lit(1000), F.col("__n") - F.col("__run") * 1000)
    rows = runs.withColumn("__at", F.explode(F.sequence(F.lit(0), (width - 1).cast("int"))))
    return rows.select(F.xxhash64(*cols, F.col("__run") * 1000 + F.col("__at")).alias(key), *cols)


def target_prefix(col: str | Column = "account_code", length: int = 6) -> Column:
    """Classification target = account-code prefix."""
    c = F.col(col) if isinstance(col, str) else col
    return F.substring(c, 1, length)


def class_counts(df: DataFrame, target: str = "target") -> DataFrame:
    """A1: rows per class (partial aggregation map-side; output one row per class)."""
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n_rows"))


def filter_rare_classes(df: DataFrame, min_class_samples: int | None,
                        target: str = "target") -> DataFrame:
    """Keep classes with at least ``min_class_samples`` rows.

    The class table (a row per class) is written once; counted small, it is broadcast, and the ledger is
    not shuffled by class, so a hot class cannot concentrate in one task."""
    if min_class_samples is None or min_class_samples <= 1:
        return df
    kept = class_counts(df, target).filter(F.col("n_rows") >= min_class_samples).select(target)
    return _by_class(df, kept, target, "left_semi")


def _by_class(df: DataFrame, classes: DataFrame, target: str, how: str) -> DataFrame:
    """Join the ledger to a table of classes without moving the ledger, if the table is counted small.
    A larger one is joined by shuffle, where adaptive execution splits hot classes."""
    classes = written(classes, "classes")
    if classes.count() <= BROADCAST_CLASSES:
        classes = F.broadcast(classes)
    return df.join(classes, on=target, how=how)


def prepare_ledger(df: DataFrame, target_length: int = 6,
                   min_class_samples: int | None = None, date_format: str | list | None = None) -> DataFrame:
    """Coerce amounts and dates, fill text nulls, derive ``target``, drop rare classes.

    ``date_format``: pattern of text dates, or several in the order they are tried (None: ISO; "infer": all that occur,
    the most frequent first)."""
    check_required_columns(df)
    if date_format == "infer":
        date_format = infer_date_formats(df)
    replaced = {
        "debit": coerce_amount(df, "debit"),
        "credit": coerce_amount(df, "credit"),
        "posting_date": coerce_date(df, "posting_date", date_format),
        **{c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in TEXT_COLUMNS},
    }
    cols = []
    if "txn_id" in df.columns:
        cols.append(F.col("txn_id").cast("bigint").alias("txn_id"))
    cols.append(F.col("account_code").cast("string").alias("account_code"))
    for c in ("description", "remarks", "reference", "debit", "credit", "posting_date"):
        cols.append(replaced[c].alias(c))
    extra = [F.col(c) for c in df.columns if c not in set(REQUIRED_COLUMNS) | {"txn_id", "target"}]
    out = df.select(*cols, *extra,
                    target_prefix(F.col("account_code").cast("string"), target_length).alias("target"))
    return filter_rare_classes(out, min_class_samples)


def ledger_checks(df: DataFrame) -> DataFrame:
    """P3 + P8 as one row: n_rows and whether any amount is non-zero."""
    nonzero = (F.col("debit") != 0) | (F.col("credit") != 0)
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.coalesce(F.max(nonzero.cast("int")), F.lit(0)).alias("has_amounts"))


def validate_ledger(df: DataFrame) -> int:
    """Run the P3 / P8 guards in one job; returns the row count."""
    row = ledger_checks(df).first()
    if row["n_rows"] == 0:
        raise ValueError("the ledger is empty: no row was read, or min_class_samples left no class")
    if not row["has_amounts"]:
        raise ValueError("no row of the ledger has an amount: debit and credit are 0 or unreadable throughout")
    return int(row["n_rows"])


def load_ledger(raw: DataFrame, target_length: int = 6, min_class_samples: int | None = None,
                date_format: str | list | None = "infer") -> DataFrame:
    """Rows as a source delivers them → checked ledger: a key if they have none (P1-P11), then the guards
    P3 and P8 once.  The ledger is written before the check, so the source is read once."""
    check_required_columns(raw)
    out = written(prepare_ledger(with_key(raw), target_length, min_class_samples, date_format), "ledger")
    validate_ledger(out)
    return out


def with_amount(df: DataFrame) -> DataFrame:
    """amount = debit + credit, nulls as 0."""
    return df.withColumn("amount", F.coalesce(F.col("debit"), F.lit(0.0))
                         + F.coalesce(F.col("credit"), F.lit(0.0)))


def drop_undated(df: DataFrame, date_col: str = "posting_date") -> DataFrame:
    """Rows without a parseable date cannot be placed in time."""
    return df.filter(F.col(date_col).isNotNull())


def known_classes(train: DataFrame, target: str = "target") -> DataFrame:
    return train.select(target).distinct()


def keep_known_classes(val: DataFrame, train: DataFrame, target: str = "target") -> DataFrame:
    """Validation rows whose class was seen in training (semi-join)."""
    return _by_class(val, known_classes(train, target), target, "left_semi")


def unseen_class_rows(val: DataFrame, train: DataFrame, target: str = "target") -> DataFrame:
    """J2 complement: validation rows with a class absent from training (anti-join)."""
    return _by_class(val, known_classes(train, target), target, "left_anti")


def label_table(train: DataFrame, target: str = "target") -> DataFrame:
    """Sorted class list → index (0-based, alphabetical, like a label encoder).

    One row per class; ``dense_rank`` over this already-aggregated table is a
    single small task."""
    from pyspark.sql import Window
    classes = train.select(F.col(target).alias("code")).filter(F.col("code").isNotNull()).distinct()
    return classes.select("code", (F.dense_rank().over(Window.orderBy("code")) - 1)
                          .cast("int").alias("label"))


def encode_labels(df: DataFrame, labels: DataFrame, target: str = "target") -> DataFrame:
    """J3 encode: inner join to the label table (drops unknown classes)."""
    return _by_class(df, labels.withColumnRenamed("code", target), target, "inner")


def decode_labels(df: DataFrame, labels: DataFrame, label_col: str = "prediction",
                  out: str = "code") -> DataFrame:
    """J3 decode: index → code."""
    lab = labels.select(F.col("label").alias(label_col), F.col("code").alias(out))
    return df.join(lab, on=label_col, how="left")
