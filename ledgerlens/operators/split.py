"""Chronological train / validation split (W1, P9, K1) and its statistics.

The first ``floor(n * ratio)`` rows in ``(posting_date, txn_id)`` order are the
training part.  A global ``row_number`` would move every row into one task, so
the boundary row is located instead by distributed selection:

1. one aggregate gives ``n`` and the key range;
2. rows are counted per key bucket (1,024 equal-width buckets of the range) --
   a partial aggregate, so even a day holding a third of all rows is split
   over every task -- and only the bucket holding rank ``k`` is kept;
3. step 2 repeats on that bucket (width shrinks 1,024-fold per pass) until at
   most ``leaf_rows`` candidates remain, then ``row_number`` over those few
   rows names the exact boundary ``(micros, txn_id)``.

The split itself is then a narrow filter on the boundary: no shuffle, no sort.
Only bucket counts (at most 1,024 rows) and one boundary row reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .normalize import drop_undated

BUCKETS = 1024
LEAF_ROWS = 100_000     # candidates of one bucket that are sorted at once
_T = "__t_us"   # order key 1: microseconds since epoch


@dataclass
class SplitBoundary:
    n_rows: int            # dated rows
    n_train: int
    micros: int | None     # order key of the last training row (None: empty train)
    txn_id: int | None

    def is_train(self, date_col: str = "posting_date", key: str = "txn_id") -> Column:
        if self.n_train <= 0 or self.micros is None:
            return F.lit(False)
        t = _micros(date_col)
        return (t < F.lit(self.micros)) | ((t == F.lit(self.micros))
                                           & (F.col(key) <= F.lit(self.txn_id)))


def _micros(date_col: str) -> Column:
    return F.unix_micros(F.col(date_col).cast("timestamp"))


def _locate(frame: DataFrame, keys: list[str], k: int, lo: int, hi: int, n: int,
            leaf_rows: int, refined: bool = False) -> dict:
    """Values of ``keys`` of the k-th row (1-based) of ``frame`` in key order.

    ``frame`` holds only rows with keys[0] in [lo, hi] and has ``n`` rows.  It is always refined by bucket
    counts first; only what one bucket leaves is sorted."""
    while True:
        if refined and n <= leaf_rows:
            w = Window.orderBy(*keys)   # bounded: at most leaf_rows rows
            row = (frame.select(*keys, F.row_number().over(w).alias("__rn"))
                   .filter(F.col("__rn") == k).first())
            return {c: row[c] for c in keys}
        if lo == hi:
            if len(keys) == 1:          # duplicate full keys: any of them is the k-th
                return {keys[0]: lo}
            rest = keys[1:]
            st = frame.agg(F.min(rest[0]).alias("lo"), F.max(rest[0]).alias("hi")).first()
            found = _locate(frame, rest, k, int(st["lo"]), int(st["hi"]), n, leaf_rows)
            return {keys[0]: lo, **found}
        width = max(1, math.ceil((hi - lo + 1) / BUCKETS))
        bucket = F.floor((F.col(keys[0]) - F.lit(lo)) / F.lit(width)).cast("long")
        counts = sorted((int(r["b"]), int(r["c"])) for r in
                        frame.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect())
        before = 0
        for b, c in counts:
            if before + c >= k:
                break
            before += c
        k -= before
        n = c
        lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
        frame = frame.filter(F.col(keys[0]).between(lo, hi))
        refined = True


def find_boundary(df: DataFrame, train_ratio: float = 0.80, date_col: str = "posting_date",
                  key: str = "txn_id", leaf_rows: int = LEAF_ROWS) -> SplitBoundary:
    """Locate the last training row of the chronological split (see module doc)."""
    if not 0.0 <= train_ratio <= 1.0:
        raise ValueError("train_ratio must be within [0, 1]")
    if date_col not in df.columns:
        raise ValueError(f"Column '{date_col}' is not present in the DataFrame")
    keyed = drop_undated(df, date_col).select(_micros(date_col).alias(_T),
                                              F.col(key).cast("long").alias(key))
    st = keyed.agg(F.count(F.lit(1)).alias("n"), F.min(_T).alias("lo"),
                   F.max(_T).alias("hi")).first()
    n = int(st["n"])
    n_train = int(n * train_ratio)
    if n_train <= 0:
        return SplitBoundary(n, 0, None, None)
    found = _locate(keyed, [_T, key], n_train, int(st["lo"]), int(st["hi"]), n, leaf_rows)
    return SplitBoundary(n, n_train, int(found[_T]), int(found[key]))


def label_split(df: DataFrame, boundary: SplitBoundary, date_col: str = "posting_date",
                key: str = "txn_id") -> DataFrame:
    """Dated rows with ``part`` = 'train' / 'val' (narrow projection)."""
    return (drop_undated(df, date_col)
            .withColumn("part", F.when(boundary.is_train(date_col, key), F.lit("train"))
                        .otherwise(F.lit("val"))))


def split_by_date(df: DataFrame, train_ratio: float = 0.80, date_col: str = "posting_date",
                  key: str = "txn_id") -> tuple[DataFrame, DataFrame, SplitBoundary]:
    """(train, validation, boundary).  Undated rows are dropped."""
    b = find_boundary(df, train_ratio, date_col, key)
    dated = drop_undated(df, date_col)
    is_train = b.is_train(date_col, key)
    return dated.filter(is_train), dated.filter(~is_train), b


def split_reference_form(df: DataFrame, train_ratio: float = 0.80,
                         date_col: str = "posting_date", key: str = "txn_id") -> DataFrame:
    """The textbook form: global row_number (single task).  For small frames and tests."""
    dated = drop_undated(df, date_col)
    w = Window.orderBy(date_col, key)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return (dated.withColumn("__rn", F.row_number().over(w))
            .withColumn("part", F.when(F.col("__rn") <= F.floor(n * F.lit(train_ratio)),
                                       F.lit("train")).otherwise(F.lit("val")))
            .drop("__rn"))


# ---------------------------------------------------------------- statistics
def class_presence(labelled: DataFrame, target: str = "target",
                   date_col: str = "posting_date") -> DataFrame:
    """One row per class: rows and date range in each part (one partial aggregate)."""
    is_tr = F.col("part") == "train"
    when_tr = lambda c: F.when(is_tr, c)            # noqa: E731
    when_va = lambda c: F.when(~is_tr, c)           # noqa: E731
    d = F.col(date_col)
    return labelled.groupBy(target).agg(
        F.count(when_tr(F.lit(1))).alias("n_train"),
        F.count(when_va(F.lit(1))).alias("n_val"),
        F.min(when_tr(d)).alias("train_first"), F.max(when_tr(d)).alias("train_last"),
        F.min(when_va(d)).alias("val_first"), F.max(when_va(d)).alias("val_last"),
    )


def classes_shared(labelled: DataFrame, target: str = "target") -> DataFrame:
    """Classes present in both parts."""
    tr = labelled.filter(F.col("part") == "train").select(target)
    va = labelled.filter(F.col("part") == "val").select(target)
    return tr.intersect(va)


def classes_train_only(labelled: DataFrame, target: str = "target") -> DataFrame:
    """Classes seen only in training (EXCEPT)."""
    tr = labelled.filter(F.col("part") == "train").select(target)
    va = labelled.filter(F.col("part") == "val").select(target)
    return tr.subtract(va)


def classes_val_only(labelled: DataFrame, target: str = "target") -> DataFrame:
    """Classes seen only in validation (EXCEPT)."""
    tr = labelled.filter(F.col("part") == "train").select(target)
    va = labelled.filter(F.col("part") == "val").select(target)
    return va.subtract(tr)


def split_stats(labelled: DataFrame, n_undated: Column | int = 0, target: str = "target",
                date_col: str = "posting_date") -> DataFrame:
    """M6 / A3-A5: one row of split statistics from the per-class table.

    Class sets (shared / exclusive) and coverage come from the same per-class
    aggregate, so the whole report is one shuffle of class-level rows."""
    # the null class forms one group: its rows count, it is not a class
    pc = class_presence(labelled, target, date_col)
    has_cls = F.col(target).isNotNull()
    in_tr, in_va = (F.col("n_train") > 0) & has_cls, (F.col("n_val") > 0) & has_cls
    total = F.sum(F.col("n_train") + F.col("n_val"))
    n_tr, n_va = F.sum("n_train"), F.sum("n_val")
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    agg = pc.agg(
        total.alias("total_rows"), n_tr.alias("train_rows"), n_va.alias("val_rows"),
        (n_tr / total).alias("train_fraction"), (n_va / total).alias("val_fraction"),
        F.count(F.when(in_tr, 1)).alias("train_n_classes"),
        F.count(F.when(in_va, 1)).alias("val_n_classes"),
        fmt(F.min("train_first")).alias("train_first"), fmt(F.max("train_last")).alias("train_last"),
        fmt(F.min("val_first")).alias("val_first"), fmt(F.max("val_last")).alias("val_last"),
        F.count(F.when(in_tr & in_va, 1)).alias("shared_classes"),
        F.count(F.when(in_tr & ~in_va, 1)).alias("train_exclusive_classes"),
        F.count(F.when(in_va & ~in_tr, 1)).alias("val_exclusive_classes"),
        F.coalesce(F.sum(F.when(in_tr, F.col("n_val")).otherwise(0)) / F.nullif(n_va, F.lit(0)),
                   F.lit(0.0)).alias("val_coverage"),
    )
    nu = n_undated if isinstance(n_undated, Column) else F.lit(int(n_undated))
    return agg.withColumn("n_undated", nu.cast("long"))
