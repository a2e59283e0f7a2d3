"""What the two text classifiers share: a bounded labelled sample, and sums of large count vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import held_out, written


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, limit: int, seed: int = 1) -> DataFrame:
    """(doc_id, text, label) of about ``limit`` labelled documents at most, none of them held out.

    The choice is by hash of the id, so it is the same on every run.  ``limit`` bounds the broadcast side;
    texts are joined where they are read.  An id with several labels counts with the largest."""
    usable = (labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy(F.col("doc_id").alias("of")).agg(F.max(F.col(target).cast("int")).alias("label")))
    n = usable.count()
    part = int(min(1.0, limit / max(n, 1)) * (1 << 30))
    chosen = usable.filter(F.pmod(F.xxhash64("of", F.lit(seed)), F.lit(1 << 30)) < part)
    return (docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
            .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label"))


def vector_rows(total: np.ndarray, parts: int):
    """A count vector as (part, data) rows for ``sum_vectors``."""
    cut = np.array_split(np.ascontiguousarray(total.reshape(-1)), parts)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(parts), pa.int32()), pa.array([c.astype(np.int64).tobytes() for c in cut], pa.binary())],
        names=["part", "data"])


def sum_vectors(rows: DataFrame, parts: int, name: str) -> np.ndarray:
    """Element-wise sum of the vectors that tasks sent as ``vector_rows``.  Each part is summed as a stream,
    so memory is one vector whatever the number of tasks; the result is one vector of fixed length."""
    def add(it):
        total: dict[int, np.ndarray] = {}
        for b in it:
            for part, data in zip(b["part"].to_pylist(), b["data"]):
                v = np.frombuffer(data.as_buffer(), np.int64)
                if part in total:
                    total[part] += v
                else:
                    total[part] = v.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(
            [v.tobytes() for v in total.values()], pa.binary())], names=["part", "data"])
    summed = written(rows.repartition(parts, "part").mapInArrow(add, "part int, data binary"), name)
    got = {r.part: np.frombuffer(bytes(r.data), np.int64) for r in summed.collect()}
    return np.concatenate([got[i] for i in range(parts)]) if got else np.zeros(0, np.int64)
