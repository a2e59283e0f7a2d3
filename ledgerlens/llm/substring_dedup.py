"""Substring dedup (operator 6): difference-cover anchors.

Every run of ``width`` words that also starts anywhere else is repeated, and the words it covers go.  To find
such runs without sending a hash per position, anchors of q = width - v + 1 words are hashed only where the
position in the text modulo ``v`` lies in a difference cover of v: for any two places of one run some shift
below v puts both on the cover, so both texts send an equal anchor inside the run.

 1. Anchors are counted.  An anchor seen once proves that no run around it is repeated.
 2. Runs that contain a repeated anchor are extended to their full width: their hash of all ``width`` words
    is counted.  Those seen once are returned to their document; all others are repeated.
 3. Each document removes the words that its repeated runs cover.

Counting is a streamed pass over hash-sorted partitions that compares neighbouring rows, so no group is held
in memory.  What a batch of texts already knows to be repeated is not sent per row: one witness row per batch
goes to the count, so a passage in a third of all documents does not fill one task.  Counting is by row, not
by id, so ids may be null or repeated: equal rows are each other's copies.

Null, empty or blank text: no words, nothing removed, kept text empty.  Texts shorter than ``width`` keep
all words.  Kept words are joined by one space.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import words as wd
from ledgerlens.llm.common import table, written

WIDTH, PERIOD = 35, 21
_NONE = -(1 << 63)
_SENT = "h long, k long, kind byte"          # kind 0: one row of the batch; 1: known to be repeated; 2: witness


@lru_cache
def difference_cover(v: int) -> tuple[int, ...]:
    """Smallest set of residues whose differences are all residues modulo v."""
    for size in range(1, v + 1):
        for rest in combinations(range(1, v), size - 1):
            cover = (0, *rest)
            if len({(a - b) % v for a in cover for b in cover}) == v:
                return cover
    return ()


def positions(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in the row, words of the row) of every word."""
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - first[row], n


def runs(words: np.ndarray, first: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, position) of all runs of ``width`` words, in rows of ``least`` words or more."""
    row, pos, n = positions(first)
    h = wd.sequence_hash(words, width)
    row, pos = row[:len(h)], pos[:len(h)]
    ok = (pos + width <= n[row]) & (n[row] >= least)
    return h[ok], row[ok], pos[ok]


def anchors(words, first, width, v):
    h, row, pos = runs(words, first, width - v + 1, width)
    on = np.zeros(v, bool)
    on[list(difference_cover(v))] = True
    on = on[pos % v]
    return h[on], row[on], pos[on]


def in_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One key per (hash, row)."""
    return wd.mix64(h + (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def twice_in_row(h, row):
    _, back, n = np.unique(in_row(h, row), return_inverse=True, return_counts=True)
    return n[back] > 1


def to_send(h, row, k, tell_known: bool, alone=None) -> pa.RecordBatch:
    """Rows of one batch for the count.  ``alone`` marks entries known to be repeated by themselves."""
    order = np.lexsort((row, h))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])           # one entry per row and hash
    known = np.zeros(len(h), bool) if alone is None else alone[order]
    known = np.logical_or.reduceat(known, np.flatnonzero(new)) if len(h) else known
    h, row = h[new], row[new]
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    size = np.diff(np.append(np.flatnonzero(head), len(h)))
    many = np.repeat(size > 1, size) | known
    single = ~many
    witness = many & head
    parts = [(h[single], k[row[single]], 0), (h[witness], np.full(int(witness.sum()), _NONE), 2)]
    if tell_known:
        parts.append((h[many], k[row[many]], 1))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([p[0] for p in parts]).view(np.int64)),
         pa.array(np.concatenate([p[1] for p in parts]).astype(np.int64)),
         pa.array(np.concatenate([np.full(len(p[0]), p[2], np.int8) for p in parts]))], names=["h", "k", "kind"])


def counted(sent: DataFrame, repeated: bool) -> DataFrame:
    """(k, h) of the kind 0 rows whose hash occurs again (or not again), and of all kind 1 rows."""
    def stream(it):
        last_h, waiting, open_run = None, None, False              # the last run so far: hash, its only row, longer than 1
        for b in it:
            h, k, kind = (b[c].to_numpy() for c in ("h", "k", "kind"))
            through = kind == 1
            out_k, out_h = [k[through]], [h[through]]
            h, k, kind = h[~through], k[~through], kind[~through]
            if len(h):
                head = np.append(True, h[1:] != h[:-1])
                size = np.diff(np.append(np.flatnonzero(head), len(h)))
                again = np.repeat(size > 1, size)
                joined = last_h is not None and h[0] == last_h
                if joined:
                    again[:size[0]] = True
                if waiting is not None and joined == repeated:
                    out_k.append(np.array([waiting]))
                    out_h.append(np.array([last_h]))
                if joined and len(size) == 1:
                    open_run = True
                else:
                    open_run = size[-1] > 1
                last_h, waiting = h[-1], None
                pick = (again == repeated) & (kind == 0)
                if not open_run:                                    # the last row may still be continued
                    pick[-1] = False
                    waiting = k[-1] if kind[-1] == 0 else None
                out_k.append(k[pick])
                out_h.append(h[pick])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_k).astype(np.int64)),
                                              pa.array(np.concatenate(out_h).astype(np.int64))], names=["k", "h"])
        if waiting is not None and not repeated:
            yield pa.RecordBatch.from_arrays([pa.array([waiting], pa.int64()), pa.array([last_h], pa.int64())], names=["k", "h"])

    spread = F.when(F.col("kind") == 1, F.xxhash64("h", "k")).otherwise(F.col("h"))
    return sent.repartition(spread).sortWithinPartitions("h").mapInArrow(stream, "k long, h long")


def per_document(found: DataFrame, name: str) -> DataFrame:
    """(k, <name>): the hashes of each document (bounded by its words)."""
    return found.groupBy("k").agg(F.collect_list("h").alias(f"{name}__"))


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of a column of lists."""
    column = column.fill_null([]) if column.null_count else column
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.repeat(np.arange(len(n)), n)


def candidate_runs(b, words, first, width, v):
    """(hash, row, position) of the runs that contain a repeated anchor."""
    h, row, pos = anchors(words, first, width, v)
    hit = np.isin(in_row(h, row), in_row(*lists(b["shared__"]))) | twice_in_row(h, row)
    start = first[row[hit]] + pos[hit]
    edge = np.zeros(len(words) + 2, np.int64)
    np.add.at(edge, np.maximum(start - v + 1, first[row[hit]]), 1)
    np.add.at(edge, start + 1, -1)
    near = np.cumsum(edge)[:len(words)] > 0
    h, row, pos = runs(words, first, width, width)
    on = near[first[row] + pos]
    return h[on], row[on], pos[on]


def dedup_substrings(docs: DataFrame, width: int = WIDTH, period: int = PERIOD) -> DataFrame:
    """``docs`` with ``text`` replaced by its kept words, plus n_words and n_removed (in place of
    columns of these names)."""
    docs = docs.drop("n_words", "n_removed")
    names = docs.columns
    base = docs.withColumn("k__", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)))

    def send_anchors(it):
        for b in wd.bounded(it):
            words, first = wd.column_words(b["text"])
            h, row, _ = anchors(words, first, width, period)
            yield to_send(h, row, b["k__"].to_numpy(), True)

    def send_runs(it):
        for b in wd.bounded(it):
            words, first = wd.column_words(b["text"])
            h, row, _ = candidate_runs(b, words, first, width, period)
            yield to_send(h, row, b["k__"].to_numpy(), False, twice_in_row(h, row))

    def remove(it):
        for b in wd.bounded(it):
            body, at = wd.raw_bytes(b["text"])
            words, first = wd.column_words(b["text"])
            h, row, pos = candidate_runs(b, words, first, width, period)
            once = np.isin(in_row(h, row), in_row(*lists(b["once__"]))) & ~twice_in_row(h, row)
            start = (first[row] + pos)[~once]
            edge = np.zeros(len(words) + width + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + width, -1)
            gone = np.cumsum(edge)[:len(words)] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            n_gone = total[first[1:]] - total[first[:-1]]
            text = []
            for i in range(b.num_rows):
                ws = body[at[i]:at[i + 1]].tobytes().split()
                if n_gone[i]:
                    ws = [ws[j] for j in np.flatnonzero(~gone[first[i]:first[i + 1]])]
                text.append(b" ".join(ws))
            kept = pa.array(text, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [kept if c == "text" else b[c] for c in names] + [pa.array(np.diff(first).astype(np.int64)), pa.array(n_gone.astype(np.int64))],
                names=[*names, "n_words", "n_removed"])

    shared = written(per_document(counted(base.select("text", "k__").mapInArrow(send_anchors, _SENT), True), "shared"),
                     "substring-shared").withColumnRenamed("k", "k__")
    marked = base.join(shared, "k__", "left")
    once = per_document(counted(marked.mapInArrow(send_runs, _SENT), False), "once").withColumnRenamed("k", "k__")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return marked.join(once, "k__", "left").mapInArrow(remove, f"{kinds}, n_words long, n_removed long")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed",
                                         F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS MATERIALIZED (SELECT k, i, array_to_string(ws[i:i + {WIDTH - 1}], ' ') AS run
    FROM (SELECT k, ws, unnest(range(1, len(ws) - {WIDTH - 2})) AS i FROM d)),
r AS MATERIALIZED (SELECT run FROM x GROUP BY run HAVING count(*) > 1),
g AS MATERIALIZED (SELECT DISTINCT k, i + o AS ix FROM (SELECT k, i, unnest(range({WIDTH})) AS o FROM x WHERE run IN (SELECT run FROM r))),
l AS (SELECT k, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS ix FROM d),
s AS (SELECT l.k, count(g.ix) AS n_removed, string_agg(w, ' ' ORDER BY l.ix) FILTER (WHERE g.ix IS NULL) AS kept
    FROM l LEFT JOIN g ON l.k = g.k AND l.ix = g.ix GROUP BY l.k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.k = s.k
"""
