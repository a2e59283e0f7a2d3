"""Connected components of an edge table, with DataFrame functions only.

Each round every node points at its smallest neighbour (itself included), the pointers are shortened twice,
and the edges are rewritten to the pointed-at nodes; edges inside a component vanish.  Pointers only ever
lead to smaller nodes of the same component, so the last label of a node is its component's smallest node.
A node with very many edges is reduced by a partial aggregate, and the rewriting join can be split by
adaptive execution.  Each round's tables are written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import written


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """``edges`` (a, b) -> (node, component) for every node that has an edge to another node; component is
    the smallest node of it.  Nulls and loops are ignored; repeats and both directions are allowed."""
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    live = written(edges.filter("a <> b").select(*ordered(F.col("a"), F.col("b"))).distinct(), f"{name}-edges")
    labels = None
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
            "node", F.least("node", "low").alias("to"))
        step = written(step, f"{name}-step")
        hop = lambda t, far: (t.join(far.select(F.col("node").alias("n2"), F.col("to").alias("t2")),
                                     F.col("to") == F.col("n2"), "left")
                              .select("node", F.coalesce("t2", "to").alias("to")))
        short = written(hop(hop(step, step), step), f"{name}-short")
        labels = short if labels is None else hop(labels, short)
        labels = written(labels, f"{name}-labels")
        pa, pb = (short.select(F.col("node").alias(f"n{x}"), F.col("to").alias(f"t{x}")) for x in "ab")
        live = written(live.join(pa, F.col("a") == F.col("na")).join(pb, F.col("b") == F.col("nb"))
                       .filter("ta <> tb").select(*ordered(F.col("ta"), F.col("tb"))).distinct(), f"{name}-edges")
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("to").alias("component"))
