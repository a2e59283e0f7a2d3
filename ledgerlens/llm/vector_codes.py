"""Vector code compression (operator 13): product quantisation by member-resident Lloyd rounds, in integers.

Each component x becomes floor(1024 x).  Vectors are cut into ``parts`` consecutive parts; each part position
has a codebook of at most ``entries`` entries, first those of the smallest ids.

A part lives with its owner, (position, entry, salt): rows are stored by owner, and the salt deals the members of
an entry over as many owners as the table needs, so neither an entry that holds a third of all rows nor a row that
is repeated as often is a hot key.

 1. The first assignment deals every part to its owner: one shuffle of the table.
 2. Update: owners sum their resident members where they are; only sums, one row for each task and entry, are
    exchanged.  The new codebooks (parts x entries, a fixed bound) go back to all tasks.
 3. Migration: residents find their nearest entry anew.  Parts that keep their entry stay in place; only those
    that change it go through the next shuffle, to their new owner.
 4. After the last update one narrow pass over the vectors gives codes and errors; no part has to be collected.

Everything is integer arithmetic, so results depend neither on the order of rows nor on partitions.  Each round
is written to the shared checkpoint folder; a lost executor costs at most the running round.

Vectors that are null, or hold null or non-finite components, are dropped.  Components beyond +-131072 count as
that, so that errors fit a long.  Vectors of each length have codebooks of their own.  A length that the number of
parts does not divide gives the first parts one component more; empty vectors have the code of entry 0 and error 0.
Ties go to the lower index; entries without members stay; with fewer vectors than entries there are fewer
entries.  Equal ids are ordered by their components; null ids come last.  Extra columns are ignored (a missing
label is null).  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import table, written

# Fixed values of the task.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
MOST = 1 << 27                  # of a scaled component
RESIDENTS = 4096                # members of an owner, on average, if one entry holds them all
STEP = 4096                     # rows compared at once
Codebooks = dict[int, list[np.ndarray]]


def cuts(dim: int, parts: int) -> list[int]:
    """Bounds of the parts of a vector."""
    return np.cumsum([0] + [len(p) for p in np.array_split(np.arange(dim), parts)]).tolist()


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row; ties to the lower index.  Exact: products
    of doubles as long as every sum stays below 2**53, of integers otherwise."""
    index, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if not x.shape[1]:
        return index, least
    top = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * top * top * x.shape[1] < 1 << 53 else np.int64
    e = entries.astype(kind)
    norm = (e * e).sum(1)
    for a in range(0, len(x), STEP):
        part = x[a:a + STEP].astype(kind)
        far = norm - 2 * (part @ e.T)                          # plus the row's own norm: the same for all entries
        i = far.argmin(1)
        index[a:a + STEP] = i
        least[a:a + STEP] = (far[np.arange(len(part)), i] + (part * part).sum(1)).astype(np.int64)
    return index, least


def scaled(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, integer matrix) for every length of the vectors in an array column without nulls."""
    flat = np.nan_to_num(np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE))
    flat = np.clip(flat, -MOST, MOST).astype(np.int64)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(size) - size
    return [(rows, flat[at[rows][:, None] + np.arange(d)]) for d in np.unique(size) for rows in [np.flatnonzero(size == d)]]


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the vectors that take part; v as doubles."""
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label, v.alias("v")).filter(F.col("v").isNotNull() & fine)


def first_codebooks(kept: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the smallest ids of every vector length, as integers: at most ``entries`` rows a length.

    Per-task lists of the smallest rows are merged; lengths are few (one, as a rule)."""
    out: Codebooks = {}
    for dim in sorted(r[0] for r in kept.select(F.size("v")).distinct().collect()):
        rows = kept.filter(F.size("v") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
        whole = scaled(pa.array([r.v for r in rows], pa.list_(pa.float64())))[0][1]
        at = cuts(dim, parts)
        out[dim] = [whole[:, a:z] for a, z in zip(at[:-1], at[1:])]
    return out


_PART = "dim int, pos int, entry int, salt int, k long, data binary"


def _batch(dim, pos, entry, salt, k, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(k), dim, np.int32)), pa.array(np.full(len(k), pos, np.int32)), pa.array(entry.astype(np.int32)),
         pa.array(salt.astype(np.int32)), pa.array(k), pa.array([r.tobytes() for r in data.astype(np.int32)], pa.binary())],
        names=["dim", "pos", "entry", "salt", "k", "data"])


def _owners(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows at their owners: a shuffle by (length, position, entry, salt)."""
    return rows.repartition(tasks, "dim", "pos", "entry", "salt")


def _settled(kept: DataFrame, books, salts: int, parts: int) -> DataFrame:
    """All parts of all vectors with their first owner, before the shuffle."""
    def deal(it):
        for b in it:
            key = b["k"].to_numpy()
            for rows, x in scaled(b["v"]):
                at = cuts(x.shape[1], parts)
                for pos, (a, z) in enumerate(zip(at[:-1], at[1:])):
                    entry, _ = nearest(x[:, a:z], books.value[x.shape[1]][pos])
                    yield _batch(x.shape[1], pos, entry, (key[rows] + np.arange(len(rows))) % salts, key[rows], x[:, a:z])
    return kept.select(F.xxhash64("vec_id", "v").bitwiseAND(F.lit((1 << 62) - 1)).alias("k"), "v").mapInArrow(deal, _PART)


def _residents(b: pa.RecordBatch):
    """(length, position, rows, entries, parts) of the groups of a batch."""
    dim, pos, entry = (b[x].to_numpy() for x in ("dim", "pos", "entry"))
    for d, p in sorted(set(zip(dim.tolist(), pos.tolist()))):
        rows = np.flatnonzero((dim == d) & (pos == p))
        data = b["data"].take(pa.array(rows))
        x = np.frombuffer(b"".join(data.to_pylist()), np.int32).reshape(len(rows), -1).astype(np.int64)
        yield d, p, rows, entry[rows], x


def _updated(residents: DataFrame, books: Codebooks) -> Codebooks:
    """New codebooks: floor of the mean of each entry's members, summed where they live."""
    def add(it):
        total: dict = {}
        for b in it:
            for d, p, _, entry, x in _residents(b):
                sums, n = total.setdefault((d, p), (np.zeros_like(books[d][p]), np.zeros(len(books[d][p]), np.int64)))
                np.add.at(sums, entry, x)
                n += np.bincount(entry, minlength=len(n))
        out = [(d, p, int(e), int(n[e]), sums[e].tolist()) for (d, p), (sums, n) in total.items() for e in np.flatnonzero(n)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
            (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=["dim", "pos", "entry", "n", "sums"])
    rows = residents.mapInArrow(add, "dim int, pos int, entry int, n long, sums array<long>")
    means = (rows.select("dim", "pos", "entry", "n", F.posexplode_outer("sums").alias("at", "s"))
             .groupBy("dim", "pos", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
    new = {d: [e.copy() for e in book] for d, book in books.items()}
    for r in means:                                            # at most entries x components of a vector
        if r["at"] is not None:
            new[r["dim"]][r["pos"]][r["entry"], r["at"]] = r["s"] // r["n"]
    return new


def _migrated(residents: DataFrame, books, salts: int, tasks: int, name: str) -> DataFrame:
    """The residents under new codebooks: who keeps the entry stays, the others go to their new owner; written."""
    def look(stay: bool):
        def run(it):
            for b in it:
                for d, p, rows, entry, x in _residents(b):
                    to, _ = nearest(x, books.value[d][p])
                    keep = to == entry if stay else to != entry
                    if keep.any():
                        key = b["k"].to_numpy()[rows[keep]]
                        yield _batch(d, p, to[keep], (key + np.arange(len(key))) % salts, key, x[keep])
        return run
    stay = residents.mapInArrow(look(True), _PART)
    move = _owners(residents.mapInArrow(look(False), _PART), tasks)
    return written(stay.union(move), name)


def codebooks_sha256(books: list[np.ndarray]) -> str:
    """Hash of all entries as decimal integers, by part, entry, position within the part."""
    return hashlib.sha256(",".join(str(v) for e in books for v in e.reshape(-1).tolist()).encode()).hexdigest()


def train_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` rounds of assignment and update, per vector length."""
    spark = kept.sparkSession
    books = first_codebooks(kept, parts, entries)
    if not books:
        return books
    salts = max(1, -(-kept.count() // RESIDENTS))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), salts)
    here = written(_owners(_settled(kept, spark.sparkContext.broadcast(books), salts, parts), tasks), "codes-round")
    for turn in range(rounds):
        if turn:
            here = _migrated(here, spark.sparkContext.broadcast(books), salts, tasks, "codes-round")
        books = _updated(here, books)
    return books


def encode(kept: DataFrame, books: Codebooks, parts: int = PARTS) -> DataFrame:
    """``kept`` rows (vec_id, label) with code, error and the hash of their codebooks."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    sha = {d: codebooks_sha256(b) for d, b in books.items()}

    def code(it):
        for b in it:
            codes, error, of = np.zeros((b.num_rows, parts), np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for rows, x in scaled(b["v"]):
                at = cuts(x.shape[1], parts)
                of[rows] = x.shape[1]
                for pos, (a, z) in enumerate(zip(at[:-1], at[1:])):
                    codes[rows, pos], far = nearest(x[:, a:z], shared.value[x.shape[1]][pos])
                    error[rows] += far
            yield pa.RecordBatch.from_arrays(
                [b["vec_id"], b["label"], pa.array(["".join(f"{i:02x}" for i in r) for r in codes.tolist()], pa.string()),
                 pa.array(error), pa.array([sha[d] for d in of.tolist()], pa.string())],
                names=["vec_id", "label", "code", "error", "codebooks_sha256"])
    label = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(code, f"vec_id long, label {label}, code string, error long, codebooks_sha256 string")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every vector that takes part."""
    kept = kept_vectors(vectors)
    coded = written(encode(kept, train_codebooks(kept, parts, entries, rounds), parts), "codes")
    total = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(total, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of the rounds, for vectors of one length that ``parts`` divides."""
    near = """a{i} AS MATERIALIZED (SELECT vec_id, pos, min({{'d': d, 'e': e}}) AS b FROM (
    SELECT v.vec_id, v.pos, c.e, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{i} c ON v.pos = c.pos AND v.ix = c.ix
    GROUP BY v.vec_id, v.pos, c.e) GROUP BY vec_id, pos)"""
    move = """c{j} AS MATERIALIZED (SELECT c.pos, c.e, c.ix, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT v.pos, a.b.e AS e, v.ix, ((sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
    FROM v JOIN a{i} a ON v.vec_id = a.vec_id AND v.pos = a.pos GROUP BY v.pos, a.b.e, v.ix) m
    ON c.pos = m.pos AND c.e = m.e AND c.ix = m.ix)"""
    steps = [s for i in range(rounds) for s in (near.format(i=i), move.format(i=i, j=i + 1))] + [near.format(i=rounds)]
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, embedding AS y FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, i // (n // {parts}) AS pos, i % (n // {parts}) AS ix, floor({SCALE} * y[i + 1]::DOUBLE)::BIGINT AS x
    FROM (SELECT vec_id, y, len(y) AS n, unnest(range(len(y))) AS i FROM k)),
c0 AS MATERIALIZED (SELECT pos, e, ix, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k)
    USING (vec_id) WHERE e < {entries}),
{(',' + chr(10)).join(steps)},
s AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY pos, e, ix)) AS codebooks_sha256 FROM c{rounds}),
r AS (SELECT vec_id, string_agg(printf('%02x', b.e), '' ORDER BY pos) AS code, sum(b.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT r.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM r JOIN k USING (vec_id), s
"""


OP13_SQL = _oracle()


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")
