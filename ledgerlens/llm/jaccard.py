"""N-gram Jaccard join (operator 1): size-banded tiles with hashed bitmap signatures, exact to the last link.

A document is the set of its distinct word n-grams (64-bit hashes).  Two documents link when the Jaccard
similarity of their sets reaches a threshold.  The result is the connected components of all links.

 1. Classes.  Documents with equal sets (known by a hash of the set, and its size) are one class; copies are
    never compared or expanded.  Each class has a bitmap of its hashed n-grams, four to eight bits per n-gram.
 2. Tiles.  A linked pair shares an n-gram among the first n - ceil(t n) + 1 of either set in any common
    order, and the smaller one has it among its first n - ceil(2t / (1 + t) n) + 1.  The order is rarest
    first, by a fixed-size table of hashed document counts over the whole corpus, so common passages do not
    form tiles.  A tile is the classes with one such n-gram in size order; only sizes within t count.
 3. Bitmaps.  For bitmaps x, y of sets A, B the overlap is at most min(|A| - |x \\ y|, |B| - |y \\ x|) in bit
    counts; pairs whose bound is too small are dropped.
 4. Exact.  The n-grams of both texts are intersected as sorted arrays.

Pairs are found in rounds, so a group of near copies is not expanded into all its pairs.  First the pairs of
neighbours in size order of every tile are checked and their components formed.  A tile of two classes is then
settled; a tile within one component needs nothing more.  What is left, classes of one tile in different
components, is compared by bitmap in blocks of bounded size; for each two components the pairs with the best
bounds are checked exactly, components are formed anew, and where two are still apart the next round tries
sixteen times more, until none is left untried.  Every linked pair shares a tile, so no link between components
can be missed.

Null or blank text: empty set, linked with nothing, its own component.  Fewer words than n: the whole
sequence is the one n-gram.  Ties in order do not matter (prefixes include them).  Repeated rows are copies.
Null ids: components ignore them (the smallest id of a component is null only if all are).  Very long texts
are handled whole.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import words as wd
from ledgerlens.llm.common import table, written
from ledgerlens.llm.components import connected_components
from ledgerlens.llm.learn import sum_vectors, vector_rows
from ledgerlens.llm.substring_dedup import in_row, runs

GRAM, NUM, DEN = 5, 75, 100
SKETCH_BITS = 18
BLOCK = 512
MOST = 2                        # pairs tried first for each two components of a block; 16 times more next
_NONE = -(1 << 63)


def sets_of(column: pa.Array, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row) of the distinct n-grams, sorted by row and hash, and the set size of every row."""
    words, first = wd.column_words(column, lower=True)
    n = np.diff(first)
    parts = [runs(words, first, gram, gram)[:2]]
    for short in range(1, gram):
        rows = np.flatnonzero(n == short)
        if len(rows):
            parts.append((wd.sequence_hash(words, short)[first[rows]], rows))
    h, row = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, row, np.bincount(row, minlength=len(n))


def set_hash(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of each row's set (any order); 0 for an empty one."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(wd.mix64(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    at = np.concatenate([[0], np.cumsum(size)])
    return np.where(size > 0, wd.mix64(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64)), np.uint64(0))


def bitmap_width(size: np.ndarray) -> np.ndarray:
    """Power of two of at least four times the size, 64 to 2**20."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(4 * size, 1))), 6, 20).astype(np.int64)


def bitmaps(h: np.ndarray, row: np.ndarray, size: np.ndarray) -> list[bytes]:
    width = bitmap_width(size)
    at = np.concatenate([[0], np.cumsum(width)])
    flat = np.zeros(at[-1], bool)
    flat[at[row] + (h & (width[row] - 1).astype(np.uint64)).astype(np.int64)] = True
    packed = np.packbits(flat).tobytes()
    return [packed[a // 8:b // 8] for a, b in zip(at[:-1], at[1:])]


def overlap_bound(a: bytes, b: bytes, size_a: int, size_b: int) -> int:
    """Upper bound of the intersection size, from bit counts."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):                      # fold the wider one: a bit of half the width is the or of two
        if len(x) > len(y):
            x = x[:len(x) // 2] | x[len(x) // 2:]
        else:
            y = y[:len(y) // 2] | y[len(y) // 2:]
    x, y = x.view(np.uint64), y.view(np.uint64)
    return min(size_a - int(np.bitwise_count(x & ~y).sum()), size_b - int(np.bitwise_count(y & ~x).sum()))


def enough(overlap, size_a, size_b, num: int, den: int):
    return den * overlap >= num * (size_a + size_b - overlap)


def _signatures(docs: DataFrame, gram: int) -> tuple[DataFrame, np.ndarray]:
    """(per row: doc_id, n, c) and the hashed counts of documents per n-gram."""
    parts = 16

    def scan(it):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in wd.bounded(it):
            h, row, size = sets_of(b["text"], gram)
            counts += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(size.astype(np.int32)), pa.array(set_hash(h, size).view(np.int64)),
                 pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())],
                names=["doc_id", "n", "c", "part", "data"])
        v = vector_rows(counts, parts)
        empty = [pa.nulls(parts, t) for t in (pa.int64(), pa.int32(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*empty, v["part"], v["data"]], names=["doc_id", "n", "c", "part", "data"])
    out = written(docs.mapInArrow(scan, "doc_id long, n int, c long, part int, data binary"), "jaccard-sets")
    sketch = sum_vectors(out.filter("part is not null").select("part", "data"), parts, "jaccard-counts")
    return (out.filter("part is null").select("doc_id", "n", "c"),
            sketch if len(sketch) else np.zeros(1 << SKETCH_BITS, np.int64))


def _prefixes(docs: DataFrame, sketch: np.ndarray, gram: int, num: int, den: int) -> DataFrame:
    """(g, m, c): the first n-grams of every class in rarest-first order; m is twice the set size, plus one
    if the n-gram is among those that the smaller of a pair must have."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch.astype(np.uint64))

    def emit(it):
        rank, seen = np.minimum(shared.value, (1 << 24) - 1), np.zeros(0, np.uint64)
        for b in wd.bounded(it):
            h, row, size = sets_of(b["text"], gram)
            c = set_hash(h, size)
            fresh = np.zeros(len(c), bool)                    # a class once per task
            fresh[np.unique(c, return_index=True)[1]] = True
            fresh &= (size > 0) & ~np.isin(c, seen)
            seen = np.union1d(seen, c[fresh])
            keep = fresh[row]
            h, row = h[keep], row[keep]
            order = (rank[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(40)) | (h >> np.uint64(24))
            by = np.lexsort((order, row))
            h, row, order = h[by], row[by], order[by]
            n = size[row]
            start = np.concatenate([[0], np.cumsum(np.where(fresh, size, 0))])[:-1]
            last = lambda p: order[start[row] + p - 1]        # noqa: E731  the p-th of the row, ties included below
            probe = n - -(-num * n // den) + 1
            index = n - -(-2 * num * n // (den + num)) + 1
            use = order <= last(probe)
            first = order <= last(index)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[use].view(np.int64)), pa.array((2 * n + first)[use].astype(np.int64)),
                 pa.array(c[row[use]].view(np.int64))], names=["g", "m", "c"])
    return docs.select("text").mapInArrow(emit, "g long, m long, c long")


def _tiles(prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """kind 0: pairs (a, b, na, nb) of size neighbours; kind 1: (a: tile, b: class, na: m) of tiles of three
    classes or more.  Streams over rows sorted by n-gram, size and class."""
    limit = 50_000

    def stream(it):
        rest = None                                           # rows of the run that may go on
        told = 0                                              # of these, rows already given out as tile rows

        def settle(g, m, c, done, more):
            """Output for whole runs; ``more``: the only run goes on, which makes it a tile of any size."""
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
            done_rows = int(new[:done].sum())
            g, m, c = g[new], m[new], c[new]
            same = np.zeros(len(g), bool)
            same[1:] = g[1:] == g[:-1]
            head = np.flatnonzero(~same)
            size = np.diff(np.append(head, len(g)))
            n = m >> 1
            i = np.flatnonzero(same)
            i = i[(den * n[i - 1] >= num * n[i]) & (m[i - 1] & 1 == 1)]
            if done_rows:
                i = i[i >= done_rows]
            pair = np.unique(np.stack([c[i - 1], c[i], n[i - 1], n[i]], 1), axis=0) if len(i) else np.zeros((0, 4), np.int64)
            big = (size > 2) | more | ((np.arange(len(size)) == 0) & (done_rows > 0))
            mark = np.add.reduceat(wd.mix64(wd.mix64(c.view(np.uint64)) + m.astype(np.uint64)), head)
            once = np.zeros(len(size), bool)                  # equal tiles of this batch once
            once[np.unique(mark, return_index=True)[1]] = True
            if more or done_rows:
                once[:] = True
            t = np.repeat(big & once, size)
            t[:done_rows] = False
            zero = np.zeros(int(t.sum()), np.int64)
            cols = [np.concatenate([np.zeros(len(pair), np.int8), np.ones(len(zero), np.int8)]),
                    np.concatenate([pair[:, 0], g[t]]), np.concatenate([pair[:, 1], c[t]]),
                    np.concatenate([pair[:, 2], m[t]]), np.concatenate([pair[:, 3], zero])]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["kind", "a", "b", "na", "nb"])

        for batch in it:
            cols = [batch[x].to_numpy() for x in ("g", "m", "c")]
            if rest is not None:
                cols = [np.concatenate([r, x]) for r, x in zip(rest, cols)]
            g = cols[0]
            if not len(g):
                continue
            cut = int(np.searchsorted(g, g[-1], "left"))      # the last run starts here
            if cut:
                yield settle(*(x[:cut] for x in cols), told, False)
                told = 0
            rest = [x[cut:] for x in cols]
            if len(rest[0]) > limit:
                yield settle(*rest, told, True)
                rest, told = [x[-1:] for x in rest], 1
        if rest is not None and len(rest[0]):
            yield settle(*rest, told, False)
    return prefixes.repartition("g").sortWithinPartitions("g", "m", "c").mapInArrow(
        stream, "kind byte, a long, b long, na long, nb long")


def listed_only(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``ids`` (one column): a filter before a shuffle, not a join.

    The ids set bits of one map of 2**23 hashed places, at most 256 rows of 4 KB, which is broadcast whatever
    the number of ids.  Rows that pass by chance are left to the join that follows."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 23)) + 1
    at = place(F.col(ids.columns[0]))
    maps = (ids.select(F.bitmap_bucket_number(at).alias("bucket__"), F.bitmap_bit_position(at).alias("bit"))
            .groupBy("bucket__").agg(F.bitmap_construct_agg("bit").alias("map__")))
    own = place(F.col(key))
    byte = F.substring(F.col("map__"), (F.floor(F.bitmap_bit_position(own) / 8) + 1).cast("int"), F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.bitmap_bit_position(own) % 8)
    return (df.join(F.broadcast(maps), F.bitmap_bucket_number(own) == F.col("bucket__")).filter(bit == 1)
            .select(*df.columns))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("k"), "text")


def _bitmaps_of(docs: DataFrame, classes: DataFrame, found: DataFrame, gram: int) -> DataFrame:
    """(c, n, bits) of the classes that occur in ``found``, read from the texts that represent them."""
    c = found.select(F.explode(F.when(F.col("kind") == 0, F.array("a", "b")).otherwise(F.array("b"))).alias("c")).distinct()
    k = classes.join(c, "c", "left_semi").select("k")

    def draw(it):
        for b in wd.bounded(it):
            h, row, size = sets_of(b["text"], gram)
            yield pa.RecordBatch.from_arrays(
                [pa.array(set_hash(h, size).view(np.int64)), pa.array(size.astype(np.int32)), pa.array(bitmaps(h, row, size), pa.binary())],
                names=["c", "n", "bits"])
    drawn = listed_only(_texts(docs), "k", k).select("text").mapInArrow(draw, "c long, n int, bits binary")
    return written(drawn.groupBy("c", "n").agg(F.first("bits").alias("bits")), "jaccard-bitmaps")


def _bounded(pairs: DataFrame, maps: DataFrame, num: int, den: int) -> DataFrame:
    """``pairs`` (a, b, na, nb) whose bitmaps allow a link."""
    def side(x):
        return maps.select(F.col("c").alias(x), F.col("n").cast("long").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))

    def bound(it):
        for b in it:
            na, nb = b["na"].to_numpy(), b["nb"].to_numpy()
            up = np.array([overlap_bound(x, y, p, q) for x, y, p, q in
                           zip(b["bits_a"].to_pylist(), b["bits_b"].to_pylist(), na.tolist(), nb.tolist())], np.int64)
            yield b.filter(pa.array(enough(up, na, nb, num, den))).select(["a", "b", "na", "nb"])
    return written(pairs.join(side("a"), ["a", "na"]).join(side("b"), ["b", "nb"])
                   .select("a", "b", "na", "nb", "bits_a", "bits_b")
                   .mapInArrow(bound, "a long, b long, na long, nb long"), "jaccard-bounded")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, gram: int, num: int, den: int) -> DataFrame:
    """The linked ones (a, b) of ``pairs`` (a, b, na, nb), by exact intersection of both texts' n-grams."""
    def side(x):
        return classes.select(F.col("c").alias(x), F.col("n").cast("long").alias(f"n{x}"), F.col("k").alias(f"k{x}"))

    def exact(it):
        for b in wd.bounded(it, "text_a", 4 << 20):
            ha, ra, sa = sets_of(b["text_a"], gram)
            hb, rb, sb = sets_of(b["text_b"], gram)
            both = np.bincount(rb[np.isin(in_row(hb, rb), in_row(ha, ra))], minlength=b.num_rows)
            # an id that several texts share may bring a text of another class
            right = (set_hash(ha, sa).view(np.int64) == b["a"].to_numpy()) & (set_hash(hb, sb).view(np.int64) == b["b"].to_numpy())
            yield b.filter(pa.array(right & enough(both, sa, sb, num, den))).select(["a", "b"])
    if pairs.isEmpty():
        return pairs.select("a", "b")
    left = written(pairs.join(side("a"), ["a", "na"]).join(side("b"), ["b", "nb"]).select("a", "b", "ka", "kb"), "jaccard-ids")
    text = listed_only(_texts(docs), "k", left.select(F.explode(F.array("ka", "kb")).alias("k")))
    a = left.join(text.withColumnsRenamed({"k": "ka", "text": "text_a"}), "ka")
    return written(a.join(text.withColumnsRenamed({"k": "kb", "text": "text_b"}), "kb").select("a", "b", "text_a", "text_b")
                   .mapInArrow(exact, "a long, b long"), "jaccard-links")


def compare_block(m, c, comp, own, bits, one_block: bool, num: int, den: int, most: int) -> list[np.ndarray]:
    """(a, b, na, nb, cut) of the pairs of a block in different components whose bitmaps allow a link: for
    each two components the ``most`` best bounds; ``cut`` is 1 if there are more."""
    n = m >> 1
    order = np.lexsort((c, n))
    m, n, c, comp, own = m[order], n[order], c[order], comp[order], own[order]
    maps = [np.frombuffer(bits[i], np.uint64) for i in order]
    wide = np.array([len(x) for x in maps])
    stacks = {w: (np.flatnonzero(wide == w), np.stack([x for x in maps if len(x) == w])) for w in set(wide.tolist())}
    low = np.searchsorted(den * n, num * n, "left")                 # sizes from here on are near enough
    xs, ys, bounds = [], [], []
    for y in range(1, len(n)):
        own_map = maps[y]
        for w in (wide[y], wide[y] // 2):                           # a smaller set's map is as wide or half as wide
            if w not in stacks or not w:
                continue
            at, stack = stacks[w]
            k = np.flatnonzero((at >= low[y]) & (at < y) & (m[at] & 1 == 1) & (comp[at] != comp[y])
                               & (one_block | (own[at] != own[y])))
            if len(k):
                mine = own_map if len(own_map) == w else own_map[:w] | own_map[w:]
                x = at[k]
                up = np.minimum(n[x] - np.bitwise_count(stack[k] & ~mine).sum(1, dtype=np.int64),
                                n[y] - np.bitwise_count(mine & ~stack[k]).sum(1, dtype=np.int64))
                ok = enough(up, n[x], n[y], num, den)
                xs.append(x[ok])
                ys.append(np.full(int(ok.sum()), y))
                bounds.append(up[ok])
    if not xs:
        return [np.zeros(0, np.int64)] * 5
    x, y, up = np.concatenate(xs), np.concatenate(ys), np.concatenate(bounds)
    lo, hi = np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])
    by = np.lexsort((c[y], c[x], -up / (n[x] + n[y] - up), hi, lo))
    x, y, lo, hi = x[by], y[by], lo[by], hi[by]
    head = np.ones(len(x), bool)
    head[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    size = np.diff(np.append(np.flatnonzero(head), len(x)))
    rank = np.arange(len(x)) - np.repeat(np.flatnonzero(head), size)
    keep = rank < most
    return [c[x][keep], c[y][keep], n[x][keep], n[y][keep], np.repeat(size > most, size)[keep].astype(np.int64)]


def _rest_of_tiles(tiles: DataFrame, labels: DataFrame, maps: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """Pairs (tile, a, b, na, nb, cut) of classes in one tile and different components whose bitmaps allow a
    link."""
    names = ["tile", "a", "b", "na", "nb", "cut"]
    member = (tiles.join(labels.withColumnsRenamed({"node": "c"}), "c", "left")
              .select("tile", "c", "m", F.coalesce("component", "c").alias("comp")))
    member = written(member, "jaccard-members")
    live = (member.groupBy("tile").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                       F.bit_xor(F.xxhash64("c", "m")).alias("mark"))
            .filter("lo <> hi").groupBy("mark", "size").agg(F.min("tile").alias("tile")))       # equal tiles once
    live = written(live.select("tile", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "jaccard-live")
    own = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    dealt = (member.join(live, "tile").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("tile", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "m", "c", "comp"))
    dealt = dealt.join(maps, (dealt.c == maps.c) & (F.shiftright(dealt.m, 1) == maps.n)).select(
        "tile", "i", "j", "own", "m", dealt.c, "comp", "bits")

    def compare(it):
        def settle(key, held):
            own, m, c, comp, bits = zip(*held)
            pairs = compare_block(*(np.array(v, np.int64) for v in (m, c, comp, own)), bits, key[1] == key[2], num, den, most)
            return [np.full(len(pairs[0]), key[0]), *pairs]
        now, held = None, []                                        # one block of a tile: at most about 2 * BLOCK rows
        for b in it:
            out = []
            for row in zip(*(b[x].to_pylist() for x in ("tile", "i", "j", "own", "m", "c", "comp", "bits"))):
                if row[:3] != now:
                    if held:
                        out.append(settle(now, held))
                    now, held = row[:3], []
                held.append(row[3:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*out)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in settle(now, held)], names=names)
    pairs = (dealt.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j")
             .mapInArrow(compare, "tile long, a long, b long, na long, nb long, cut long"))
    return written(pairs, "jaccard-rest")


def jaccard_components(docs: DataFrame, gram: int = GRAM, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, sketch = _signatures(docs, gram)
    classes = written(rows.filter("n > 0").groupBy("c", "n").agg(
        F.min("doc_id").alias("least"), F.min(F.coalesce("doc_id", F.lit(_NONE))).alias("k")), "jaccard-classes")
    found = written(_tiles(_prefixes(docs, sketch, gram, num, den), num, den), "jaccard-tiles")
    pair = ["a", "b", "na", "nb"]
    near = written(found.filter("kind = 0").select(*pair).distinct(), "jaccard-pairs")
    maps = _bitmaps_of(docs, classes, found, gram)
    links = _verified(_bounded(near, maps, num, den), classes, docs, gram, num, den)
    labels = connected_components(links, "jaccard-cc")
    tiles = found.filter("kind = 1").select(F.col("a").alias("tile"), F.col("b").alias("c"), F.col("na").alias("m"))
    tried, most = near, MOST
    while True:
        rest = _rest_of_tiles(tiles, labels, maps, num, den, most)
        far = written(rest.select(*pair).distinct().join(tried, pair, "left_anti"), "jaccard-far")
        more = _verified(far, classes, docs, gram, num, den)
        if not more.isEmpty():
            links = written(links.union(more), "jaccard-links")
            labels = connected_components(links, "jaccard-cc")
        cut = written(rest.filter("cut = 1").select("tile").distinct(), "jaccard-cut")
        if cut.isEmpty():                                           # every pair that is left has been tried
            break
        tiles = written(tiles.join(cut, "tile", "left_semi"), "jaccard-tiles")
        tried = written(tried.union(far), "jaccard-tried")
        most *= 16
    comp = (classes.select("c", "n", "least").join(labels.withColumnsRenamed({"node": "c"}), "c", "left")
            .select("c", "n", "least", F.coalesce("component", "c").alias("comp")))
    comp = written(comp, "jaccard-comp")
    least = comp.groupBy("comp").agg(F.min("least").alias("component_id"))
    of = comp.join(least, "comp").select("c", "n", "component_id")
    return (rows.select("doc_id", "n", "c").join(of, ["c", "n"], "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
