"""Report and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Write a small report frame (metrics, comparison) as one file per report."""
    df.coalesce(1).write.mode(mode).format(fmt).save(path)


def write_comparison(df: DataFrame, path: str, sort_col: str = "balanced_accuracy") -> None:
    """Model-comparison results sorted by a metric, best first."""
    write_report(df.orderBy(F.desc(sort_col)), path)
