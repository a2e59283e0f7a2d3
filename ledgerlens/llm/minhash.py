"""MinHash near-dedup (operator 11): a signature-coordinate inverted join, confirmed on full sets.

A document is the set of its distinct word n-grams (64-bit hashes).  Its signature has ``coordinates`` values:
under each of as many hash functions the smallest value of the set.  Two sets of Jaccard similarity s agree in
each coordinate with probability s, independently, so the number of agreeing coordinates (collisions) is
binomial.  ``match_threshold`` takes the largest number of matches that a linked pair misses with probability
2e-8 at most (36 of 64 at 0.85); that chance is the only way to lose a link.

 1. Classes.  Documents with equal sets (known by a hash of the set) are one class; copies are never compared.
 2. Posting.  Every class is posted under each (coordinate, value) pair.  Pairs that occur once cannot collide and
    are dropped; a class with fewer shared pairs than the match threshold has no partner and is dropped too.
 3. Prefix.  In one common order, rarest first, two classes with ``matches`` collisions share a pair among the
    first ``coordinates - matches + 1`` of either.  Only these lists are merged; single-occurrence pairs come
    first, so what is left of a prefix is its rarest shared pairs.  The long lists are never read as lists.
 4. Hubs.  In each list every class is compared with the one that shares most (highest sum of log frequencies):
    in a family of edited copies that is the original.  Links form components; a list of two, or within one
    component, is settled.
 5. Skip merging.  Of the other lists, classes are cut by size band and hash into cells of bounded size; two cells
    make a block, and those of a list's largest component only meet the list's other classes.  In a block the
    coordinates of all pairs in different components are counted in steps; a pair that cannot reach the threshold
    any more is skipped, and when none is left so is the block.  Pairs above it are intersected exactly, and a
    block gives a spanning forest of its links: never more rows than it has classes.

Every linked pair above the match threshold shares a prefix list, so none between components is left out.
Counts are partial aggregates, joins on hot keys are split by adaptive execution, and a hot list is dealt over
many blocks.  Tables that are read again are written to the shared checkpoint folder.

Null or blank text: empty set, linked with nothing, its own component.  Fewer words than n: the whole sequence
is the one n-gram.  Repeated rows are copies.  Null ids: components ignore them (the smallest id of a component
is null only if all are), and such a row is kept only if no row of its component has an id.  Ties in order
are broken by value.  Very long texts are handled whole.  An empty table gives an empty result.  Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import words as wd
from ledgerlens.llm.common import table, written
from ledgerlens.llm.components import connected_components
from ledgerlens.llm.jaccard import listed_only, set_hash, sets_of

GRAM, NUM, DEN = 3, 85, 100
COORDINATES = 64
MISS = 2e-8
BLOCK = 512                     # classes of a cell; a block has two cells at most
CELL_GRAMS = 1 << 19            # n-grams of a cell, on average
COLUMNS = 4096                  # n-grams intersected at once
STEP = 8                        # coordinates counted between two looks at what is left
_EMPTY = np.uint32(0xFFFFFFFF)


def match_threshold(num: int, den: int, coordinates: int, miss: float = MISS) -> int:
    """Largest T such that a pair of similarity num / den has fewer than T collisions with probability ``miss``
    at most."""
    p, below = num / den, 0.0
    for t in range(coordinates + 1):
        below += comb(coordinates, t) * p ** t * (1 - p) ** (coordinates - t)
        if below > miss:
            return max(t, 1)
    return coordinates


def multipliers(coordinates: int) -> np.ndarray:
    """A fixed odd 64-bit number per coordinate."""
    rng = np.random.Generator(np.random.PCG64(20250611))
    return rng.integers(1, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(h: np.ndarray, size: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """(rows, coordinates) smallest values; ``h`` holds the n-grams of the rows one after another."""
    out = np.full((len(size), len(factors)), _EMPTY)
    rows = np.flatnonzero(size)
    if len(rows):
        at = (np.cumsum(size) - size)[rows]
        for i, a in enumerate(factors):
            out[rows, i] = np.minimum.reduceat(((h * a) >> np.uint64(32)).astype(np.uint32), at)
    return out


def _rows(docs: DataFrame, gram: int, coordinates: int) -> DataFrame:
    """Per row: doc_id, hash of the text, set size, class, signature; written."""
    factors = multipliers(coordinates)

    def scan(it):
        for b in wd.bounded(it, limit=2 << 20):
            h, _, size = sets_of(b["text"], gram)
            sig = signatures(h, size, factors)
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * coordinates)
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["t"], pa.array(size.astype(np.int32)), pa.array(set_hash(h, size).view(np.int64)),
                 pa.ListArray.from_arrays(offsets, pa.array(sig.reshape(-1).view(np.int32)))],
                names=["doc_id", "t", "n", "c", "sig"])
    keyed = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    return written(keyed.mapInArrow(scan, "doc_id long, t long, n int, c long, sig array<int>"), "minhash-rows")


def _candidates(classes: DataFrame, matches: int) -> DataFrame:
    """(c, n, w, prefix): classes with at least ``matches`` shared (coordinate, value) pairs, the rarest of
    these, and their weight; written."""
    pair = F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    posted = classes.select("c", "n", F.posexplode("sig").alias("i", "v")).select("c", "n", pair.alias("p"))
    often = posted.groupBy("p").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    shared = (posted.join(often, "p").groupBy("c", "n")
              .agg(F.sort_array(F.collect_list(F.struct("f", "p"))).alias("shared"), F.sum(F.log("f")).alias("w"))
              .filter(F.size("shared") >= matches))
    first = F.slice("shared", F.lit(1), F.size("shared") - (matches - 1))
    return written(shared.select("c", "n", F.round("w", 6).alias("w"), first["p"].alias("prefix")), "minhash-candidates")


def _sets(docs: DataFrame, classes: DataFrame, candidates: DataFrame, gram: int, coordinates: int) -> DataFrame:
    """(c, sig, grams) of the candidate classes, from one text of each; written."""
    need = written(classes.join(candidates.select("c"), "c", "left_semi").select("c", "t"), "minhash-needed")
    factors = multipliers(coordinates)

    def draw(it):
        seen = np.zeros(0, np.int64)
        for b in wd.bounded(it, limit=2 << 20):
            h, row, size = sets_of(b["text"], gram)
            c = set_hash(h, size).view(np.int64)
            fresh = np.zeros(len(c), bool)                    # a class once per task
            fresh[np.unique(c, return_index=True)[1]] = True
            fresh &= (size > 0) & ~np.isin(c, seen)
            seen = np.union1d(seen, c[fresh])
            h, size, c = h[fresh[row]], size[fresh], c[fresh]
            at = np.concatenate([[0], np.cumsum(size)]) * 8
            raw, sig = h.tobytes(), signatures(h, size, factors)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c), pa.array([s.tobytes() for s in sig], pa.binary()),
                 pa.array([raw[a:z] for a, z in zip(at[:-1], at[1:])], pa.binary())], names=["c", "sig", "grams"])
    texts = docs.select(F.xxhash64("text").alias("t"), "text")
    drawn = listed_only(texts, "t", need.select("t")).select("text").mapInArrow(draw, "c long, sig binary, grams binary")
    one = drawn.join(need.select("c"), "c", "left_semi").groupBy("c").agg(F.first(F.struct("sig", "grams")).alias("s"))
    return written(one.select("c", "s.sig", "s.grams"), "minhash-sets")


def linked(overlap, size_a, size_b, num: int, den: int):
    return den * overlap >= num * (size_a + size_b - overlap)


def _verified(pairs: DataFrame, sets: DataFrame, matches: int, num: int, den: int) -> DataFrame:
    """The linked ones of ``pairs`` (a, b); written."""
    def exact(it):
        for b in it:
            keep = []
            for sa, sb, ga, gb in zip(*(b[x].to_pylist() for x in ("sig_a", "sig_b", "grams_a", "grams_b"))):
                same = np.count_nonzero(np.frombuffer(sa, np.uint32) == np.frombuffer(sb, np.uint32))
                x, y = np.frombuffer(ga, np.uint64), np.frombuffer(gb, np.uint64)
                keep.append(same >= matches and linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), num, den))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])
    side = lambda x: sets.select(F.col("c").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("grams").alias(f"grams_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sig_a", "sig_b", "grams_a", "grams_b")
    return written(both.mapInArrow(exact, "a long, b long"), "minhash-links")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection size of each two of the sets, as products of 0/1 matrices over the values that recur."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    row, column = row[keep], (np.cumsum(times > 1) - 1)[column[keep]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, z = np.searchsorted(column, [lo, lo + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[a:z], column[a:z] - lo] = 1
        total += part @ part.T
    return total.astype(np.int64)


def collisions(sig: np.ndarray, open_pairs: np.ndarray, matches: int) -> np.ndarray:
    """Which of the open pairs (boolean matrix) agree in ``matches`` coordinates.  Coordinates are merged in steps;
    what cannot reach the number any more is skipped."""
    k = sig.shape[1]
    alive, count = open_pairs.copy(), np.zeros(open_pairs.shape, np.int16)
    for a in range(0, k, STEP):
        rows = np.flatnonzero(alive.any(1))
        if not len(rows):
            break
        for i in range(a, min(a + STEP, k)):
            count[rows] += sig[rows, i][:, None] == sig[None, :, i]
        alive &= count + max(0, k - a - STEP) >= matches
    return alive


def forest(adjacent: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of a graph given by a symmetric boolean matrix."""
    unseen, a, b = np.ones(len(adjacent), bool), [], []
    for start in range(len(adjacent)):
        if not unseen[start]:
            continue
        unseen[start], stack = False, [start]
        while stack:
            x = stack.pop()
            new = np.flatnonzero(adjacent[x] & unseen).tolist()
            unseen[new] = False
            a += [x] * len(new)
            b += new
            stack += new
    return a, b


def block_links(n, side, comp, sig, sets, one_cell: bool, matches: int, num: int, den: int) -> tuple[list[int], list[int]]:
    """Spanning forest of the links of a block between classes of different components."""
    n = np.asarray(n, np.int64)
    low, high = np.minimum(n[:, None], n[None, :]), np.maximum(n[:, None], n[None, :])
    pairs = (comp[:, None] != comp[None, :]) & (den * low >= num * high)
    if not one_cell:
        pairs &= side[:, None] != side[None, :]
    alive = collisions(sig, np.triu(pairs, 1), matches)
    used = np.flatnonzero(alive.any(0) | alive.any(1))
    if not len(used):
        return [], []
    alive, n = alive[np.ix_(used, used)], n[used]
    link = alive & linked(overlaps([sets[i] for i in used]), n[:, None], n[None, :], num, den)
    a, b = forest(link | link.T)
    return used[a].tolist(), used[b].tolist()


def _rest(members: DataFrame, labels: DataFrame, sets: DataFrame, matches: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that join different components within lists of three classes or more; written.

    The classes of a list's largest component need no comparison with each other: they meet only the others, so a
    list of a large family and a few strangers costs about its size times its strangers."""
    own = (members.filter("m > 2").join(labels.withColumnsRenamed({"node": "c"}), "c", "left")
           .select("p", "c", "n", F.coalesce("component", "c").alias("comp")))
    own = written(own, "minhash-members")
    # sizes of a linked pair differ by den / num at most, so they lie in one band or in neighbouring ones
    band = F.floor(F.log(F.col("n")) / F.lit(log(den / num) + 1e-3)).cast("int")
    largest = (own.groupBy("p", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("p")
               .agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("k", "comp")).alias("main"))
               .filter("comps > 1").select("p", "main"))
    own = written(own.join(largest, "p").select("p", "c", "n", "comp", band.alias("band"), (F.col("comp") == F.col("main")).alias("main")),
                  "minhash-open")

    def room(main: bool):
        here = F.col("main") == F.lit(main)
        rows, grams = F.count_if(here), F.sum(F.when(here, F.col("n").cast("long")).otherwise(0))
        return F.greatest(F.ceil(rows / F.lit(BLOCK)), F.ceil(grams / F.lit(CELL_GRAMS))).cast("int")
    cells = own.groupBy("p", "band").agg(room(True).alias("s0"), room(False).alias("o0"))
    by_list = Window.partitionBy("p").orderBy("band")         # one row per size band: some 130 for any list
    next_to = lambda f, d, c: F.when(f("band", 1).over(by_list) == F.col("band") + d, f(c, 1).over(by_list)).otherwise(0)
    cells = cells.select("p", "band", "s0", "o0", *[next_to(f, d, c).alias(f"{c[0]}{t}") for t, f, d in
                                                    (("1", F.lead, 1), ("2", F.lag, -1)) for c in ("s0", "o0")])
    place = "struct<band:int,main:boolean,i:int,other:int,other_main:boolean,j:int,side:int>"
    here, i, main = F.col("band"), F.col("i"), F.col("main")
    names = ("band", "main", "i", "other", "other_main", "j", "side")
    key = lambda *v: F.struct(*[x.alias(k) for x, k in zip(v, names)]).cast(place)
    no, yes = F.lit(False), F.lit(True)
    to = lambda n, one: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one)).otherwise(
        F.array().cast(f"array<{place}>"))
    only = lambda cond, n: F.when(cond, n).otherwise(0)
    stranger, family = ~main, main
    dealt = [                                                  # of a block's two cells, the first is named first
        to(only(stranger, F.col("o0")), lambda j: key(here, no, F.least(i, j), here, no, F.greatest(i, j), (i > j).cast("int"))),
        to(only(stranger, F.col("s0")), lambda j: key(here, no, i, here, yes, j, F.lit(0))),
        to(only(family, F.col("o0")), lambda j: key(here, no, j, here, yes, i, F.lit(1))),
        to(F.col("o1"), lambda j: key(here, main, i, here + 1, no, j, F.lit(0))),
        to(only(stranger, F.col("s1")), lambda j: key(here, no, i, here + 1, yes, j, F.lit(0))),
        to(F.col("o2"), lambda j: key(here - 1, no, j, here, main, i, F.lit(1))),
        to(only(stranger, F.col("s2")), lambda j: key(here - 1, yes, j, here, no, i, F.lit(1))),
    ]
    cell = F.pmod(F.xxhash64("c"), F.when(main, F.col("s0")).otherwise(F.col("o0"))).cast("int")
    dealt = (own.join(cells, ["p", "band"]).withColumn("i", cell).select("p", "c", "n", "comp", F.explode(F.concat(*dealt)).alias("to"))
             .select("p", "to.*", "c", "n", "comp").join(sets, "c"))

    def compare(block: pa.Table) -> pa.Table:
        c, n, side, comp = (block[x].to_numpy() for x in ("c", "n", "side", "comp"))
        if len(c) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        one = all(block[x][0] == block[y][0] for x, y in (("band", "other"), ("main", "other_main"), ("i", "j")))
        sig = np.stack([np.frombuffer(s, np.uint32) for s in block["sig"].to_pylist()])
        grams = [np.frombuffer(s, np.uint64) for s in block["grams"].to_pylist()]
        a, b = block_links(n, side, comp, sig, grams, one, matches, num, den)
        return pa.table({"a": pa.array(c[a], pa.int64()), "b": pa.array(c[b], pa.int64())})
    return written(dealt.groupBy("p", "band", "main", "i", "other", "other_main", "j").applyInArrow(compare, "a long, b long"), "minhash-rest")


def minhash_components(docs: DataFrame, gram: int = GRAM, num: int = NUM, den: int = DEN,
                       coordinates: int = COORDINATES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    matches = match_threshold(num, den, coordinates)
    rows = _rows(docs, gram, coordinates)
    classes = rows.filter("n > 0").groupBy("c", "n").agg(
        F.min("doc_id").alias("least"), F.min("t").alias("t"), F.first("sig").alias("sig"))
    classes = written(classes, "minhash-classes")
    found = _candidates(classes, matches)
    sets = _sets(docs, classes, found, gram, coordinates)
    posted = found.select("c", "n", "w", F.explode("prefix").alias("p"))
    lists = (posted.groupBy("p").agg(F.count(F.lit(1)).alias("m"), F.max_by("c", F.struct("w", "c")).alias("hub"),
                                     F.bit_xor(F.xxhash64("c")).alias("mark")).filter("m > 1")
             .groupBy("mark", "m", "hub").agg(F.min("p").alias("p")))                 # equal lists once
    members = written(posted.join(lists, "p").select("p", "c", "n", "m", "hub"), "minhash-lists")
    pairs = members.filter("c <> hub").select(F.col("hub").alias("a"), F.col("c").alias("b")).distinct()
    links = _verified(pairs, sets, matches, num, den)
    labels = connected_components(links, "minhash-cc")
    more = _rest(members, labels, sets, matches, num, den)
    if not more.isEmpty():
        labels = connected_components(links.union(more), "minhash-cc")
    comp = (classes.select("c", "n", "least").join(labels.withColumnsRenamed({"node": "c"}), "c", "left")
            .select("c", "n", "least", F.coalesce("component", "c").alias("comp")))
    comp = written(comp, "minhash-comp")
    of = comp.join(comp.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("c", "n", "component_id")
    out = rows.select("doc_id", "n", "c").join(of, ["c", "n"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def components_sql(gram: int, num: int, den: int, extra: str = "") -> str:
    """DuckDB SQL of the components: sets as lists, pairs by shared n-gram, labels spread to a fixed point."""
    return rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < {gram} THEN [list_aggregate(ws, 'string_agg', ' ')]
    ELSE list_sort(list_distinct([list_aggregate(ws[i:i + {gram - 1}], 'string_agg', ' ') FOR i IN range(1, len(ws) - {gram - 2})])) END AS g FROM w),
c AS MATERIALIZED (SELECT g, min(doc_id) AS id, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
x AS MATERIALIZED (SELECT id, n, unnest(g) AS h FROM c),
p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.h = b.h AND a.id < b.id
    AND {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n)
    GROUP BY a.id, b.id, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT id, id AS to_id FROM c UNION SELECT r.id, e.b FROM r JOIN e ON r.to_id = e.a),
m AS MATERIALIZED (SELECT id, min(to_id) AS component_id FROM r GROUP BY id),
o AS (SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
    FROM s LEFT JOIN c ON len(s.g) > 0 AND s.g = c.g LEFT JOIN m ON c.id = m.id)
SELECT doc_id, n_shingles, component_id{extra} FROM o
"""


OP11_SQL = components_sql(GRAM, NUM, DEN, ", doc_id = component_id AS kept")


def op11_minhash(spark, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"))
