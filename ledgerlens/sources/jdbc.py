"""JDBC ledger source, whole or with an explicit row limit."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

LIMIT_PLACEHOLDER = "%(limit)s"


@dataclass
class JdbcLedgerSource:
    """A database query as a ledger source.

    Whole by default.  A row limit is opt-in (``row_limit``); it is put in the place of ``%(limit)s`` in the
    query, so the database applies it, and ``read`` says so when it cut.  For parallel reads give a
    ``partition_column`` and ``num_partitions``: the query becomes a sub-select that Spark reads by ranges.  Bounds that
    are not given are asked of the database first (one row: smallest, largest).  A limit and ranges exclude each
    other, since every range would apply the limit to rows of its own.
    """

    url: str
    query: str
    row_limit: int | None = None
    properties: dict = field(default_factory=dict)
    partition_column: str | None = None
    lower_bound: int | None = None
    upper_bound: int | None = None
    num_partitions: int | None = None
    fetch_size: int = 10_000

    def __post_init__(self) -> None:
        limited = LIMIT_PLACEHOLDER in self.query
        if limited != (self.row_limit is not None):
            raise ValueError(f"row_limit and {LIMIT_PLACEHOLDER} in the query go together")
        if self.row_limit is not None and self.row_limit < 1:
            raise ValueError("a row_limit of less than one row reads nothing")
        if self.partition_column:
            if limited:
                raise ValueError("a limited query cannot be read by ranges")
            if self.num_partitions is None or (self.lower_bound is None) != (self.upper_bound is None):
                raise ValueError("partitioned reads need num_partitions, and both bounds or none")

    def bound_query(self) -> str:
        return self.query.replace(LIMIT_PLACEHOLDER, str(self.row_limit))

    def _base(self) -> dict[str, str]:
        return {"url": self.url, "fetchsize": str(self.fetch_size), **{k: str(v) for k, v in self.properties.items()}}

    def bounds_options(self) -> dict[str, str]:
        """Options that read the smallest and largest value of the partition column, as one row (low, high)."""
        c = self.partition_column
        return {**self._base(), "query": f"SELECT MIN({c}) AS low, MAX({c}) AS high FROM ({self.query}) ledger_src"}

    def with_bounds(self, spark: SparkSession) -> "JdbcLedgerSource":
        """This source with the bounds the database gives.  An empty query has none: it is read in one part."""
        row = spark.read.format("jdbc").options(**self.bounds_options()).load().first()
        if row is None or row[0] is None:
            return replace(self, partition_column=None, num_partitions=None)
        return replace(self, lower_bound=int(row[0]), upper_bound=int(row[1]) + 1)

    def options(self) -> dict[str, str]:
        opts = self._base()
        if self.partition_column:
            if self.lower_bound is None:
                raise ValueError("bounds are missing: see with_bounds")
            opts.update({
                "dbtable": f"({self.query}) ledger_src",
                "partitionColumn": self.partition_column,
                "lowerBound": str(self.lower_bound),
                "upperBound": str(self.upper_bound),
                "numPartitions": str(self.num_partitions),
            })
        else:
            opts["query"] = self.bound_query()
        return opts

    def read(self, spark: SparkSession) -> DataFrame:
        if self.partition_column and self.lower_bound is None:
            return self.with_bounds(spark).read(spark)
        out = spark.read.format("jdbc").options(**self.options()).load()
        if self.row_limit is not None and out.count() >= self.row_limit:
            warnings.warn(f"the row limit of {self.row_limit} was reached: rows may be missing", stacklevel=2)
        return out

    def fetch(self, spark: SparkSession, min_class_samples: int | None = 10,
              target_length: int = 6) -> DataFrame:
        from ..operators.normalize import load_ledger
        return load_ledger(self.read(spark), target_length, min_class_samples)
