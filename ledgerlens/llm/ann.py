"""Approximate nearest neighbours (operator 7): cross-polytope hashing with multiprobe and exact reranking.

Each of ``tables`` pseudo-rotations (three rounds of random signs and a fast Hadamard transform, vectors
padded with zeros to a power of two) sends a unit vector to its nearest signed axis, its bucket in that
table.  Every vector is indexed in all tables.  A query probes the buckets, over all tables, whose axes lie
nearest to it.  Candidates are reranked by the Euclidean distance of the original vectors in double precision.

The number of probes is first one for all: a bounded sample of queries (SAMPLE) is answered by brute force over
all vectors, and the smallest number is taken that finds the wanted share of their true neighbours.  Each query is
then judged by itself.  One that found too few vectors, or whose probes would miss more than one in ten
(VOUCH) of the vectors at the angle of its farthest find (DRAWS random ones are hashed), goes through further
rounds with more probes.  From as many probes as one table has buckets, that whole table is probed instead:
it holds every vector once, so the answer is exact.

Buckets that are large, in vectors or in queries, are cut into blocks of bounded size, so a task holds one
block of vectors and one of queries whatever the skew; nothing is dropped.  Each block returns only its best
ones for a query.  Copies of a vector are reduced beforehand to the ``k + 1`` smallest ids (the only ones
that can be returned), and equal queries are searched once.

Vectors that are null, all zero, or with null or non-finite components take no part, as candidates or as
queries; so do null ids.  Vectors are searched among those of their own length, one length that queries have
after the other (lengths are few; one, as a rule).  Rows that repeat an id count once, at their smallest distance.  With fewer than ``k`` other vectors all are returned: every bucket is probed then.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import table, written
from ledgerlens.llm.learn import sum_vectors, vector_rows

TABLES, RECALL, SAMPLE = 6, 0.97, 64
VOUCH, DRAWS = 0.9, 128
BLOCK_V, BLOCK_Q = 4096, 1024


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of ``x`` (width a power of two) under three rounds of signs and fast Hadamard transform."""
    d = x.shape[1]
    for s in signs:
        x = x * s
        h = 1
        while h < d:
            y = x.reshape(len(x), -1, 2, h)
            x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), d)
            h *= 2
        x = x / np.sqrt(d)
    return x


class Hasher:
    def __init__(self, dim: int, tables: int = TABLES, seed: int = 17):
        self.dim, self.tables = dim, tables
        self.width = 1 << max(0, (dim - 1).bit_length())
        self.signs = np.random.Generator(np.random.PCG64(seed)).choice([-1.0, 1.0], (tables, 3, self.width))
        self.buckets = tables * 2 * self.width

    def axes(self, x: np.ndarray, t: int) -> np.ndarray:
        """Inner products of the unit vectors of ``x`` with the signed axes of table ``t``."""
        unit = np.zeros((len(x), self.width))
        big = np.abs(x).max(1, keepdims=True)                 # before squares, which could underflow
        unit[:, :self.dim] = x / big
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        y = rotate(unit, self.signs[t])
        return np.concatenate([y, -y], 1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) bucket numbers over all tables."""
        return np.stack([self.axes(x, t).argmax(1) + t * 2 * self.width for t in range(self.tables)], 1)

    def probe_order(self, x: np.ndarray) -> np.ndarray:
        """(rows, buckets): all buckets, nearest axis first."""
        near = np.concatenate([self.axes(x, t) for t in range(self.tables)], 1)
        return np.argsort(-near, axis=1, kind="stable")

    def probed(self, x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, bucket) pairs of the ``p[row]`` nearest buckets; the whole first table from its size on."""
        order = self.probe_order(x)
        full = np.tile(np.arange(2 * self.width), (len(x), 1))
        whole = p >= 2 * self.width
        order[whole, :2 * self.width] = full[whole]
        n = np.minimum(p, 2 * self.width)
        row = np.repeat(np.arange(len(x)), n)
        return row, order[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]

    def need(self, q: np.ndarray, cos: np.ndarray, seeds: np.ndarray, step: int = 32) -> np.ndarray:
        """Probes of each query that find VOUCH of random vectors whose angle to it has its cosine."""
        out = np.zeros(len(q), np.int64)
        for a in range(0, len(q), step):
            u = q[a:a + step] / np.abs(q[a:a + step]).max(1, keepdims=True)
            u = u / np.linalg.norm(u, axis=1, keepdims=True)
            w = np.stack([np.random.Generator(np.random.PCG64(int(s))).normal(size=(DRAWS, self.dim)) for s in seeds[a:a + step]])
            w -= (w @ u[:, :, None]) * u[:, None, :]
            w /= np.maximum(np.linalg.norm(w, axis=2, keepdims=True), 1e-300)
            c = np.clip(cos[a:a + step], -1.0, 1.0)[:, None, None]
            codes = self.codes((c * u[:, None, :] + np.sqrt(1 - c * c) * w).reshape(-1, self.dim))
            place = np.argsort(self.probe_order(q[a:a + step]), axis=1)
            first = place[np.repeat(np.arange(len(u)), DRAWS)[:, None], codes].min(1).reshape(len(u), DRAWS)
            out[a:a + step] = np.sort(first, axis=1)[:, int(np.ceil(VOUCH * DRAWS)) - 1] + 1
        return out


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest_at(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, distances) of the k nearest rows to q, ties to the smaller id."""
    dist = np.sqrt(((x - q) ** 2).sum(1))
    if len(dist) > 4 * k:
        cut = np.partition(dist, k - 1)[k - 1]
        at = np.flatnonzero(dist <= cut)
    else:
        at = np.arange(len(dist))
    at = at[np.lexsort((ids[at], dist[at]))][:k]
    return at, dist[at]


def nearest(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest rows to q, ties to the smaller id."""
    at, dist = nearest_at(ids, x, q, k)
    return ids[at], dist


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    x, q = x / np.abs(x).max(1, keepdims=True), q / np.abs(q).max()
    return x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
           recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for every row where ``is_query(id)``."""
    spark = vectors.sparkSession
    usable = _usable(vectors, id_col, vector_col)
    size = F.size("v")
    asked = usable.filter(is_query(F.col("vec_id"))).groupBy(size.alias("dim")).count().orderBy("dim").collect()
    pairs = [_search_length(usable.filter(size == r.dim), is_query, k, r.dim, recall) for r in asked]
    if not pairs:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = pairs[0]
    for more in pairs[1:]:
        found = found.union(more)
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.filter("query_id <> vec_id")
            .groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
            .withColumn("rank", F.row_number().over(ranked).cast("int")).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _search_length(usable: DataFrame, is_query, k: int, dim: int, recall: float) -> DataFrame:
    """(query_id, vec_id, score) of the nearest found among vectors of one length; own ids are still in."""
    same = Window.partitionBy("v").orderBy("vec_id")
    pool = written(usable.distinct().withColumn("turn", F.row_number().over(same)).filter(F.col("turn") <= k + 1)
                   .select("vec_id", "v"), "ann-pool")
    asked = written(usable.filter(is_query(F.col("vec_id"))).distinct()
                    .select(F.col("vec_id").alias("query_id"), "v", F.xxhash64("v").alias("c1"), F.hash("v").alias("c2")), "ann-asked")
    classes = written(asked.groupBy("c1", "c2").agg(F.min_by("v", "query_id").alias("v")), "ann-classes")
    hasher = Hasher(dim)
    probes = min(_fit_probes(pool, classes, hasher, k + 1, recall), 2 * hasher.width)
    due, settled = classes.withColumn("p", F.lit(probes)), []
    while True:
        found = written(_round(pool, due, hasher, k), "ann-found")
        if probes >= 2 * hasher.width:                          # every query of this round was answered in full
            settled.append(found)
            break
        due = written(_unsettled(due, found, hasher, k), "ann-due")
        least = due.agg(F.min("p")).first()[0]
        if least is None:
            settled.append(found)
            break
        probes = least
        settled.append(found.join(due.select("c1", "c2"), ["c1", "c2"], "left_anti"))
    found = settled[0]
    for more in settled[1:]:
        found = found.union(more)
    return (asked.select("query_id", "c1", "c2").join(found.select("c1", "c2", "vec_id", "score"), ["c1", "c2"])
            .select("query_id", "vec_id", "score"))


def _unsettled(due: DataFrame, found: DataFrame, hasher: Hasher, k: int) -> DataFrame:
    """The queries of a round that need more probes than they had, with at least twice as many."""
    per = found.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min("cos").alias("cos"))
    asked = (due.filter(F.col("p") < 2 * hasher.width).join(per, ["c1", "c2"], "left")
             .select("c1", "c2", "v", "p", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cos", F.lit(0.0)).alias("cos")))

    def judge(it):
        for b in it:
            x, p = matrix(b["v"], hasher.dim), b["p"].to_numpy()
            n, cos, seeds = b["n"].to_numpy(), b["cos"].to_numpy(), _mixed(b["c1"].to_numpy())
            want = 8 * p.astype(np.int64)
            enough = n > k
            want[enough] = hasher.need(x[enough], cos[enough], seeds[enough])
            at = np.flatnonzero(want > p)
            more = np.minimum(np.maximum(want[at], 2 * p[at]), 2 * hasher.width).astype(np.int32)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([b["c1"].take(take), b["c2"].take(take), b["v"].take(take), pa.array(more)],
                                             names=["c1", "c2", "v", "p"])
    return asked.mapInArrow(judge, "c1 long, c2 int, v array<double>, p int")


def _round(pool: DataFrame, due: DataFrame, hasher: Hasher, k: int) -> DataFrame:
    """(c1, c2, vec_id, score, cos) of the k + 1 nearest vectors in the ``p`` probed buckets of each query."""
    dim = hasher.dim

    def count_codes(it):
        n = np.zeros(hasher.buckets, np.int64)
        for b in it:
            n += np.bincount(hasher.codes(matrix(b["v"], dim)).ravel(), minlength=hasher.buckets)
        yield vector_rows(n, 1)

    def count_probes(it):
        n = np.zeros(hasher.buckets, np.int64)
        for b in it:
            n += np.bincount(hasher.probed(matrix(b["v"], dim), b["p"].to_numpy())[1], minlength=hasher.buckets)
        yield vector_rows(n, 1)
    rows = "part int, data binary"
    zero = np.zeros(hasher.buckets, np.int64)
    held = sum_vectors(pool.select("v").mapInArrow(count_codes, rows), 1, "ann-held")
    wanted = sum_vectors(due.select("v", "p").mapInArrow(count_probes, rows), 1, "ann-wanted")
    asked_for = (wanted if len(wanted) else zero) > 0
    vblocks = np.maximum(1, -(-(held if len(held) else zero) // BLOCK_V))
    qblocks = np.maximum(1, -(-(wanted if len(wanted) else zero) // BLOCK_Q))

    def deal(row, code, own, own_blocks, far_blocks, own_first):
        """Row numbers and block keys: one block of its own side, every block of the other side."""
        mine = own[row] % own_blocks[code].astype(np.uint64)
        times = far_blocks[code]
        pick = np.repeat(np.arange(len(code)), times)
        other = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
        a, b = (mine[pick].astype(np.int64), other) if own_first else (other, mine[pick].astype(np.int64))
        return row[pick], code[pick], a, b

    def table_of(names, *columns):
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    def index(it):
        for b in it:
            x, ids = matrix(b["v"], dim), b["vec_id"].to_numpy()
            codes = hasher.codes(x)
            at = np.nonzero(asked_for[codes])                   # buckets that no query probes need no rows
            row, code, a, q = deal(at[0], codes[at], _mixed(ids), vblocks, qblocks, True)
            yield table_of(["code", "vb", "qb", "vec_id", "v"], code, a, q, ids[row], b["v"].take(pa.array(row)))

    def ask(it):
        for b in it:
            x = matrix(b["v"], dim)
            own = _mixed(b["c1"].to_numpy())
            row, code, a, q = deal(*hasher.probed(x, b["p"].to_numpy()), own, qblocks, vblocks, False)
            take = pa.array(row)
            yield table_of(["code", "vb", "qb", "c1", "c2", "v"], code, a, q, b["c1"].take(take), b["c2"].take(take), b["v"].take(take))

    key = "code long, vb long, qb long"
    left = pool.mapInArrow(index, f"{key}, vec_id long, v array<double>")
    right = due.mapInArrow(ask, f"{key}, c1 long, c2 int, v array<double>")

    def rerank(vec, ask):
        if not vec.num_rows or not ask.num_rows:
            return pa.table({"c1": pa.array([], pa.int64()), "c2": pa.array([], pa.int32()),
                             "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()),
                             "cos": pa.array([], pa.float64())})
        x, ids = matrix(vec["v"].combine_chunks(), dim), vec["vec_id"].to_numpy()
        qs = matrix(ask["v"].combine_chunks(), dim)
        found = [nearest_at(ids, x, q, k + 1) for q in qs]
        cos = [cosines(x[f[0]], q) for q, f in zip(qs, found)]
        take = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
        return pa.table({"c1": ask["c1"].take(take), "c2": ask["c2"].take(take),
                         "vec_id": ids[np.concatenate([f[0] for f in found])], "score": np.concatenate([f[1] for f in found]),
                         "cos": np.concatenate(cos)})
    keys = ("code", "vb", "qb")
    found = (left.groupBy(*keys).cogroup(right.groupBy(*keys))
             .applyInArrow(rerank, "c1 long, c2 int, vec_id long, score double, cos double")
             .groupBy("c1", "c2", "vec_id").agg(F.min("score").alias("score"), F.max("cos").alias("cos")))
    best = Window.partitionBy("c1", "c2").orderBy("score", "vec_id")
    return found.withColumn("turn", F.row_number().over(best)).filter(F.col("turn") <= k + 1).drop("turn")


def _mixed(ids: np.ndarray) -> np.ndarray:
    from ledgerlens.llm.words import mix64
    return mix64(ids.astype(np.int64).view(np.uint64)) >> np.uint64(1)


def _fit_probes(pool: DataFrame, classes: DataFrame, hasher: Hasher, k: int, recall: float) -> int:
    """Smallest number of probes that finds ``recall`` of the true neighbours of a sample of queries."""
    sample = classes.orderBy(F.xxhash64("c1", "c2"), "c1").limit(SAMPLE).collect()
    if not sample:
        return 1
    q = np.array([r.v for r in sample], np.float64)

    def truth(it):
        best = [(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, hasher.tables), np.int64)) for _ in q]
        for b in it:
            x, ids = matrix(b["v"], hasher.dim), b["vec_id"].to_numpy()
            codes = hasher.codes(x)
            for i, v in enumerate(q):
                near, dist = nearest(ids, x, v, k)
                own = codes[np.flatnonzero(np.isin(ids, near))] if len(near) else codes[:0]
                order = np.argsort(ids[np.isin(ids, near)], kind="stable")
                rank = np.argsort(np.argsort(near, kind="stable"), kind="stable")
                a, d, c = best[i]
                a, d, c = np.append(a, near), np.append(d, dist), np.concatenate([c, own[order][rank]])
                at = np.lexsort((a, d))[:k]
                best[i] = a[at], d[at], c[at]
        at = [i for i, (a, _, _) in enumerate(best) for _ in a]
        if at:
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(np.concatenate([b[0] for b in best])),
                 pa.array(np.concatenate([b[1] for b in best])),
                 pa.array(list(np.concatenate([b[2] for b in best])), pa.list_(pa.int64()))], names=["q", "vec_id", "d", "codes"])
    rows = pool.mapInArrow(truth, "q int, vec_id long, d double, codes array<long>")
    per = Window.partitionBy("q").orderBy("d", "vec_id")
    rows = rows.withColumn("turn", F.row_number().over(per)).filter(F.col("turn") <= k).select("q", "codes").collect()
    order = hasher.probe_order(q)
    place = np.argsort(order, axis=1)
    if len(rows) < k * len(q):                                  # fewer vectors than neighbours asked for: take all
        return hasher.buckets
    need = np.sort([place[r.q][list(r.codes)].min() for r in rows])
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1


def op7_cross_polytope(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
