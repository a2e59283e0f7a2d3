"""Standard numeric and calendar features."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import NULL_SENTINEL

# Right-closed amount bucket edges (log10 spacing from 1 to
# 100,000, rounded), giving codes 0-8; anything <= 0 or missing is code 0.
AMOUNT_EDGES = (0.0, 1.0, 7.0, 46.0, 316.0, 2154.0, 14678.0, 100000.0)

NUMERIC_FEATURES = ("amount", "log_amount", "is_debit", "is_credit", "amount_bucket",
                    "desc_len", "remarks_len", "has_reference")
CALENDAR_PARTS = ("weekday", "month_day", "month", "quarter")
DATE_FEATURES = CALENDAR_PARTS + (
    "is_month_end", "is_month_start", "is_weekend",
    "day_cycle_sin", "day_cycle_cos", "month_cycle_sin", "month_cycle_cos",
    "weekday_cycle_sin", "weekday_cycle_cos")


def amount_bucket(col: str | Column) -> Column:
    """Bucket code on right-closed edges (a CASE chain; Bucketizer is left-closed)."""
    c = F.col(col) if isinstance(col, str) else col
    expr = F.when(c.isNull() | F.isnan(c), F.lit(0))
    for code, edge in enumerate(AMOUNT_EDGES):
        expr = expr.when(c <= F.lit(edge), F.lit(code))
    return expr.otherwise(F.lit(len(AMOUNT_EDGES)))


def numeric_feature_columns() -> list[Column]:
    """N1 over a normalised ledger."""
    debit = F.coalesce(F.col("debit").cast("double"), F.lit(0.0))
    credit = F.coalesce(F.col("credit").cast("double"), F.lit(0.0))
    amount = debit + credit
    ref = F.col("reference")
    flag = lambda cond: F.when(cond, F.lit(1)).otherwise(F.lit(0))
    return [
        amount.alias("amount"),
        F.log1p(amount).alias("log_amount"),
        flag(debit > 0).alias("is_debit"),
        flag(credit > 0).alias("is_credit"),
        amount_bucket(amount).alias("amount_bucket"),
        F.char_length(F.coalesce(F.col("description"), F.lit(""))).cast("int").alias("desc_len"),
        F.char_length(F.coalesce(F.col("remarks"), F.lit(""))).cast("int").alias("remarks_len"),
        flag(ref.isNotNull() & (ref != "") & (ref != NULL_SENTINEL)).alias("has_reference"),
    ]


def calendar_parts(date_col: str = "posting_date") -> list[Column]:
    d = F.col(date_col)
    return [F.weekday(d).alias("weekday"), F.dayofmonth(d).alias("month_day"),
            F.month(d).alias("month"), F.quarter(d).alias("quarter")]


def fit_date_modes(df: DataFrame, date_col: str = "posting_date") -> dict[str, int]:
    """Most frequent value of each calendar part (smallest wins ties).

    One aggregate job; fitted on training rows and reused when scoring, so a
    scoring batch (or a stream micro-batch) never changes the fill values."""
    parts = df.select(*calendar_parts(date_col))
    row = parts.agg(*[F.mode(c, True).alias(c) for c in CALENDAR_PARTS]).first()
    return {c: int(row[c]) if row[c] is not None else 0 for c in CALENDAR_PARTS}


@dataclass
class DateFeatures:
    """N2 with fitted fill values for rows whose date is missing."""

    modes: dict[str, int]
    date_col: str = "posting_date"

    @classmethod
    def fit(cls, df: DataFrame, date_col: str = "posting_date") -> "DateFeatures":
        return cls(fit_date_modes(df, date_col), date_col)

    def columns(self) -> list[Column]:
        d = F.col(self.date_col)
        wd, day, mon = F.weekday(d), F.dayofmonth(d), F.month(d)
        flag = lambda cond: F.when(cond, F.lit(1)).otherwise(F.lit(0))
        two_pi = 2 * math.pi

        def cyc(fn, part, period):
            return F.coalesce(fn(F.lit(two_pi) * part / F.lit(float(period))), F.lit(0.0))

        parts = dict(zip(CALENDAR_PARTS, (wd, day, mon, F.quarter(d))))
        out = [F.coalesce(parts[c], F.lit(self.modes.get(c, 0))).alias(c) for c in CALENDAR_PARTS]
        out += [
            flag(day >= 25).alias("is_month_end"),
            flag(day <= 5).alias("is_month_start"),
            flag(wd.isin(5, 6)).alias("is_weekend"),
            cyc(F.sin, day, 31).alias("day_cycle_sin"),
            cyc(F.cos, day, 31).alias("day_cycle_cos"),
            cyc(F.sin, mon, 12).alias("month_cycle_sin"),
            cyc(F.cos, mon, 12).alias("month_cycle_cos"),
            cyc(F.sin, wd, 7).alias("weekday_cycle_sin"),
            cyc(F.cos, wd, 7).alias("weekday_cycle_cos"),
        ]
        return out

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        base = [F.col(c) for c in (keep if keep is not None else df.columns)]
        return df.select(*base, *self.columns())


def numeric_features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    base = [F.col(c) for c in (keep if keep is not None else df.columns)]
    return df.select(*base, *numeric_feature_columns())
