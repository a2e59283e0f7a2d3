"""TF-IDF text vectorisation (T1-T11) in long form and vector form.

Per block: words or text per document (column expressions) → n-grams of each
Arrow batch as numbers (``functions/grams.py``) → document / corpus frequency
per term, merged in the task and by one shuffle → vocabulary: min_df, max_df,
then the ``max_features`` most frequent terms (ties: term ascending), numbered
in term order.  Terms below min_df go before anything is kept.  The top-N
selection is a ``TakeOrderedAndProject`` (per-partition top-N, then a merge),
never a full sort.  The vocabulary is bounded by ``max_features`` and is the
only broadcast side.

Weights: sublinear TF ``1 + ln(tf)`` x smooth IDF ``ln((1+n)/(1+df)) + 1``,
L2-normalised per document and block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grams as gr
from ..functions import text as tx
from ..session import written


@dataclass(frozen=True)
class BlockSpec:
    name: str                 # block id, also the feature-name prefix
    max_features: int
    ngram: tuple[int, int]
    analyzer: str = "word"    # "word" or "char_wb"
    min_df: int = 3
    max_df: float | None = 0.95
    strip_accents: bool = True

    def tokens(self, text: Column) -> Column:
        """Per-row units the n-grams are built from (projected once, then reused)."""
        if self.analyzer == "char_wb":
            return text
        return tx.word_tokens(tx.strip_accents(text) if self.strip_accents else text)

    def grams(self, tokens: Column) -> Column:
        if self.analyzer == "char_wb":
            return tx.char_wb_ngrams(tokens, *self.ngram)
        return tx.word_ngrams(tokens, *self.ngram)

    def terms(self, text: Column) -> Column:
        return self.grams(self.tokens(text))

    def batch_grams(self, column: pa.Array):
        """(first row, n-grams) of bounded pieces of a batch's ``tokens``."""
        return gr.grams(column, *self.ngram, self.analyzer == "char_wb")


# Ledger blocks: description words, remarks words, characters of both.
LEDGER_BLOCKS = (
    BlockSpec("desc", 4000, (1, 2)),
    BlockSpec("rem", 4000, (1, 2)),
    BlockSpec("chr", 1000, (3, 5), analyzer="char_wb", max_df=None, strip_accents=False),
)


def ledger_texts(df: DataFrame, key: str = "txn_id") -> DataFrame:
    """Cleaned text per block: description, stripped remarks, both joined."""
    label = tx.normalize_text(F.col("description"))
    detail = tx.normalize_html("remarks")
    return df.select(F.col(key).alias("doc_id"), label.alias("desc"), detail.alias("rem")) \
             .withColumn("chr", F.concat(F.col("desc"), F.lit(" "), F.col("rem")))


def unit_columns(texts: DataFrame, blocks: tuple[BlockSpec, ...]) -> DataFrame:
    """(doc_id, one column per block): the words or the text that n-grams are built from in the batch."""
    return texts.select("doc_id", *[b.tokens(F.col(b.name)).alias(f"__u_{b.name}") for b in blocks])


def batch_counts(grams: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(terms, rows that hold each, occurrences of each) of one batch of term lists, without a Python object per
    term."""
    if isinstance(grams, pa.ChunkedArray):
        grams = grams.combine_chunks()
    flat = grams.flatten().dictionary_encode()
    terms = flat.dictionary
    if not len(terms):
        return terms, np.zeros(0, "int64"), np.zeros(0, "int64")
    size = grams.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    code = flat.indices.to_numpy(zero_copy_only=False).astype("int64")
    row = np.repeat(np.arange(len(grams), dtype="int64"), size)
    held = np.unique(row * len(terms) + code) % len(terms)
    return terms, np.bincount(held, minlength=len(terms)), np.bincount(code, minlength=len(terms))


MERGE_ROWS = 400_000            # counts a task gathers before it merges them; half as many are left or all are sent


class Tally:
    """Sums per term, gathered in a task and sent when merging no longer makes them fewer."""

    def __init__(self, names: tuple[str, ...]):
        self.names, self.parts, self.rows = names, [], 0

    def add(self, terms: pa.Array, *values: np.ndarray) -> None:
        if len(terms):
            self.parts.append(pa.table([terms, *map(pa.array, values)], names=["term", *self.names]))
            self.rows += len(terms)

    def merged(self) -> pa.Table | None:
        if len(self.parts) > 1:
            t = pa.concat_tables(self.parts).group_by("term").aggregate([(n, "sum") for n in self.names])
            self.parts = [t.select(["term", *[f"{n}_sum" for n in self.names]]).rename_columns(["term", *self.names])]
        self.rows = self.parts[0].num_rows if self.parts else 0
        return self.parts[0] if self.parts else None

    def taken(self, last: bool = False):
        """Batches to send now: none, or all that is held."""
        if self.rows > MERGE_ROWS or last:
            t = self.merged()
            if t is not None and (last or self.rows > MERGE_ROWS // 2):
                self.parts, self.rows = [], 0
                yield from t.combine_chunks().to_batches(50_000)


HELD_TERMS = 2_000_000          # distinct terms a task holds of a block; beyond them it sends the rarest
HELD_SYMBOLS = 500_000          # words (or characters) a task numbers for a block


class KeyTally:
    """Frequencies per n-gram, gathered in a task as numbers over the symbols it has met, so that merging is sorting whole
    numbers; strings are made for what is sent alone.  The frequent terms stay, and are sent once at the end."""

    def __init__(self, size: int, between: str):
        self.size, self.between, self.bits = size, between, 62 // size
        self.room = min(HELD_SYMBOLS, (1 << self.bits) - 1)
        self.parts, self.pending = [], 0
        self.held = np.zeros((3, 0), "int64")                  # key, df, cf
        self.ids: dict[str, int] = {}

    def fits(self, g: gr.Grams) -> bool:
        return not g.whole and len(g.symbols) <= self.room

    def add(self, g: gr.Grams):
        """Takes the counts of a piece of a batch; gives batches to send now."""
        symbols = g.symbols.to_pylist()
        if len(self.ids) + len(symbols) > self.room and len(self.ids.keys() | set(symbols)) > self.room:
            yield from self.last()
            self.ids = {}
        own = np.array([0, *[self.ids.setdefault(s, len(self.ids) + 1) for s in symbols]], "int64")
        key, df, cf = g.totals()
        ours = np.zeros(len(key), "int64")
        for place in range(self.size):
            key, digit = np.divmod(key, g.base)
            ours |= own[digit] << (place * self.bits)
        self.parts.append(np.stack([ours, df, cf]))
        self.pending += len(ours)
        if self.pending > max(MERGE_ROWS, self.held.shape[1]):
            self.merge()
            if self.held.shape[1] > HELD_TERMS:
                rare = self.held[2] <= np.median(self.held[2])
                out, self.held = self.held[:, rare], self.held[:, ~rare]
                yield from self.strings(out)

    def merge(self) -> None:
        t = np.concatenate([self.held, *self.parts], axis=1)
        self.parts, self.pending = [], 0
        t = t[:, np.argsort(t[0])]
        first = np.flatnonzero(np.append(True, t[0, 1:] != t[0, :-1])) if t.shape[1] else np.zeros(0, "int64")
        self.held = np.stack([t[0, first], *[np.add.reduceat(x, first) if len(first) else x for x in t[1:]]])

    def last(self):
        """Batches of all that is held."""
        self.merge()
        out, self.held = self.held, np.zeros((3, 0), "int64")
        yield from self.strings(out)

    def strings(self, counts: np.ndarray):
        names = pa.array(list(self.ids), pa.string())
        for a in range(0, counts.shape[1], 50_000):
            key, df, cf = counts[:, a:a + 50_000]
            cols = []
            for place in reversed(range(self.size)):
                digit = (key >> (place * self.bits)) & ((1 << self.bits) - 1)
                cols.append(names.take(pa.array(digit - 1, mask=digit == 0)))
            term = pc.binary_join_element_wise(*cols, self.between, null_handling="skip")
            yield pa.RecordBatch.from_arrays([term, pa.array(df), pa.array(cf)], names=["term", "df", "cf"])


def task_counts(texts: DataFrame, blocks: tuple[BlockSpec, ...]) -> DataFrame:
    """(block, term, df, cf) of every task.

    A document sits in one row, so a batch counts its own terms; a task merges what its batches counted, and sends one
    row per distinct term (its rarest terms more often, if it holds very many).  Terms that fit no number are merged
    as strings."""
    def count(batches):
        held = {b.name: KeyTally(b.ngram[1], "" if b.analyzer == "char_wb" else " ") for b in blocks}
        odd = {b.name: Tally(("df", "cf")) for b in blocks}

        def named(name, found):
            for out in found:
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name), out.num_rows), *out.columns], names=["block", "term", "df", "cf"])
        for batch in batches:
            for b in blocks:
                for _, g in b.batch_grams(batch[f"__u_{b.name}"]):
                    if held[b.name].fits(g):
                        yield from named(b.name, held[b.name].add(g))
                    else:
                        key, df, cf = g.totals()
                        odd[b.name].add(g.strings(key), df, cf)
                        yield from named(b.name, odd[b.name].taken())
        for name in held:
            yield from named(name, held[name].last())
            yield from named(name, odd[name].taken(True))
    return unit_columns(texts, blocks).drop("doc_id").mapInArrow(count, "block string, term string, df long, cf long")


def term_stats(texts: DataFrame, blocks: tuple[BlockSpec, ...]) -> DataFrame:
    """(block, term, df, cf) of rows that are documents, from one scan and one shuffle."""
    return task_counts(texts, blocks).groupBy("block", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def id_stats(texts: DataFrame, blocks: tuple[BlockSpec, ...]) -> DataFrame:
    """(block, term, df, cf) where rows that share an id (or have none) are one document.

    An id of one row needs no exchange by id; only the terms of ids with several rows are counted per id first."""
    of = F.col("doc_id").eqNullSafe(F.col("of"))
    several = written(texts.groupBy(F.col("doc_id").alias("of")).count().filter("count > 1").select("of"), "repeated-ids")
    shared = (term_counts(texts.join(several, of, "left_semi"), blocks).groupBy("block", "term")
              .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")))
    return (task_counts(texts.join(several, of, "left_anti"), blocks).unionByName(shared)
            .groupBy("block", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")))


def term_counts(texts: DataFrame, blocks: tuple[BlockSpec, ...]) -> DataFrame:
    """(doc_id, block, term, tf) — one explode per block, one partial aggregate."""
    parts = [texts.select("doc_id", b.tokens(F.col(b.name)).alias("__tok"))
                  .select("doc_id", F.lit(b.name).alias("block"),
                          F.explode(b.grams(F.col("__tok"))).alias("term"))
             for b in blocks]
    exploded = parts[0]
    for p in parts[1:]:
        exploded = exploded.unionByName(p)
    return exploded.groupBy("doc_id", "block", "term").agg(F.count(F.lit(1)).alias("tf"))


def batch_weights(units: pa.Array, block: BlockSpec, terms: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term index, weight) of one batch: sublinear TF x IDF with L2 norm per row, ordered by row and term index.
    No Python object per row or term."""
    parts, names = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))], terms.to_pylist()
    for first, g in block.batch_grams(units) if names else ():
        code = g.codes(names)
        known = code >= 0
        key, tf = gr.runs(g.row[known] * len(names) + code[known])
        row, code = key // len(names), key % len(names)
        w = (1.0 + np.log(tf)) * idf[code]
        norm = np.sqrt(np.bincount(row, w * w, g.n_rows))
        parts.append((row + first, code, w / norm[row]))
    return tuple(np.concatenate(x) for x in zip(*parts))


OUT_ROWS = 2_000                # rows whose weights are sent back at once


@dataclass
class TfidfModel:
    """Fitted vocabularies: ``vocab`` has block, term, df, cf, idf, col_index."""

    blocks: tuple[BlockSpec, ...]
    n_docs: int
    vocab: DataFrame
    sizes: dict[str, int] = field(default_factory=dict)

    @property
    def width(self) -> int:
        return sum(self.sizes.values())

    def transform(self, texts: DataFrame, names: tuple[str, ...] | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
        """T8 long form: (doc_id, block, term, col_index, weight), of the blocks ``names`` and with ``columns`` alone if
        they are given.

        Per Arrow batch (mapInArrow): vocabulary lookup (bounded, in the
        closure), term counts per document, sublinear TF x IDF, L2 per
        document and block.  Rows never leave their partition: no shuffle."""
        tables, blocks = self.lookup_tables(), tuple(b for b in self.blocks if names is None or b.name in names)
        schema = T.StructType([texts.schema["doc_id"], *T.StructType.fromDDL("block string, term string, col_index int, weight double")])
        schema = T.StructType([f for f in schema if columns is None or f.name in columns])

        def weigh(batches):
            for whole in batches:
                for a in range(0, whole.num_rows, OUT_ROWS):
                    batch = whole.slice(a, OUT_ROWS)
                    for b in blocks:
                        terms, idf, cols = tables[b.name]
                        row, code, weight = batch_weights(batch[f"__u_{b.name}"], b, terms, idf)
                        made = {"doc_id": lambda: batch["doc_id"].take(pa.array(row)), "block": lambda: pa.repeat(pa.scalar(b.name), len(row)),
                                "term": lambda: terms.take(pa.array(code)), "col_index": lambda: pa.array(cols[code]),
                                "weight": lambda: pa.array(weight)}
                        if len(row):
                            yield pa.RecordBatch.from_arrays([made[f.name]() for f in schema], names=schema.names)

        return unit_columns(texts, blocks).mapInArrow(weigh, schema)

    def top_terms(self, texts: DataFrame, n: int) -> DataFrame:
        """(doc_id, block, rank, term, weight) of each row's ``n`` heaviest terms per block (ties: term).  A row's terms
        are together in its batch, so nothing is shuffled."""
        tables, blocks = self.lookup_tables(), self.blocks

        def pick(batches):
            for whole in batches:
                for a in range(0, whole.num_rows, OUT_ROWS):
                    batch = whole.slice(a, OUT_ROWS)
                    for b in blocks:
                        terms, idf, _ = tables[b.name]
                        row, code, weight = batch_weights(batch[f"__u_{b.name}"], b, terms, idf)
                        by = np.lexsort((code, -weight, row))              # codes are in term order
                        row, code, weight = row[by], code[by], weight[by]
                        rank = np.arange(len(row)) - np.searchsorted(row, row)
                        keep = rank < n
                        yield pa.RecordBatch.from_arrays(
                            [batch["doc_id"].take(pa.array(row[keep])), pa.repeat(pa.scalar(b.name), int(keep.sum())),
                             pa.array((rank[keep] + 1).astype("int32")), terms.take(pa.array(code[keep])), pa.array(weight[keep])],
                            names=["doc_id", "block", "rank", "term", "weight"])

        doc_type = texts.schema["doc_id"].dataType.simpleString()
        return unit_columns(texts, self.blocks).mapInArrow(
            pick, f"doc_id {doc_type}, block string, rank int, term string, weight double")

    def lookup_tables(self) -> dict[str, tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Per block (terms, idf, column index) in column order; bounded by max_features."""
        rows = self.vocab.select("block", "term", "idf", "col_index").orderBy("col_index").collect()
        out = {}
        for b in self.blocks:
            own = [r for r in rows if r["block"] == b.name]
            out[b.name] = (pa.array([r["term"] for r in own], pa.string()),
                           np.array([r["idf"] for r in own], "float64"),
                           np.array([r["col_index"] for r in own], "int32"))
        return out

    def transform_relational(self, texts: DataFrame) -> DataFrame:
        """T8 in relational form (explode, group, broadcast join, window);
        same result as ``transform``, two shuffles keyed by document."""
        tf = term_counts(texts, self.blocks)
        v = F.broadcast(self.vocab.select("block", "term", "idf", "col_index"))
        w = tf.join(v, ["block", "term"]).withColumn(
            "w", (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id", "block")))
        return w.select("doc_id", "block", "term", "col_index", (F.col("w") / norm).alias("weight"))

    def feature_names(self) -> DataFrame:
        """Column index → prefixed name."""
        return self.vocab.select("col_index", F.concat(F.col("block"), F.lit("_"),
                                                       F.col("term")).alias("name"))

    def vocabulary(self, block: str) -> list[str]:
        """Terms of one block in column order (bounded by max_features)."""
        rows = (self.vocab.filter(F.col("block") == block).orderBy("col_index")
                .select("term").collect())
        return [r["term"] for r in rows]

    def save(self, path: str) -> None:
        """Vocabularies as Parquet (block, term, df, cf, idf, col_index)."""
        self.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
        self.vocab.sparkSession.createDataFrame([(int(self.n_docs),)], "n_docs long").coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/size")

    @classmethod
    def load(cls, spark: SparkSession, path: str, blocks: tuple[BlockSpec, ...] = LEDGER_BLOCKS,
             ) -> "TfidfModel":
        vocab = spark.read.parquet(f"{path}/vocab")
        stats = {r["block"]: r["n"] for r in vocab.groupBy("block").count()
                 .withColumnRenamed("count", "n").collect()}
        n_docs = spark.read.parquet(f"{path}/size").first()["n_docs"]
        return cls(blocks, int(n_docs), vocab, {b.name: stats.get(b.name, 0) for b in blocks})


def summaries(texts: DataFrame, blocks: tuple[BlockSpec, ...], counters: int) -> DataFrame:
    """(block, term, low) from every task: the occurrences of its frequent terms, at most 2 x ``counters`` per block, each
    too low by no more than the task's error for the block, which comes as a row without term."""
    def run(batches):
        held = {b.name: Tally(("low",)) for b in blocks}
        error = dict.fromkeys(held, 0)

        def settle(name):
            t = held[name].merged()
            if t is not None and t.num_rows > 2 * counters:    # keep the most frequent, lowered by the first that goes
                low = t["low"].to_numpy()
                cut = int(np.partition(low, len(low) - 1 - counters)[len(low) - 1 - counters])
                held[name] = Tally(("low",))
                held[name].add(t["term"].combine_chunks().filter(pa.array(low > cut)), low[low > cut] - cut)
                error[name] += cut
        for batch in batches:
            for b in blocks:
                for _, g in b.batch_grams(batch[f"__u_{b.name}"]):
                    key, cf = gr.runs(g.key)
                    held[b.name].add(g.strings(key), cf)
                    if held[b.name].rows > max(MERGE_ROWS, 4 * counters):
                        settle(b.name)
        for name in held:
            settle(name)
            t = held[name].merged()
            terms, low = (t["term"].combine_chunks(), t["low"].combine_chunks()) if t is not None else (pa.array([], pa.string()), pa.array([], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(name), len(terms) + 1), pa.concat_arrays([terms, pa.nulls(1, pa.string())]),
                 pa.concat_arrays([low, pa.array([error[name]], pa.int64())])], names=["block", "term", "low"])
    return unit_columns(texts, blocks).drop("doc_id").mapInArrow(run, "block string, term string, low long")


def recount(texts: DataFrame, blocks: tuple[BlockSpec, ...], terms: dict[str, list[str]]) -> DataFrame:
    """(block, term, df, cf) of the given terms alone; tasks send one row for each that they saw."""
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        sets = shared.value
        total = {n: np.zeros((2, len(ts)), "int64") for n, ts in sets.items()}
        for batch in batches:
            for b in blocks:
                chosen = sets[b.name]
                for _, g in b.batch_grams(batch[f"__u_{b.name}"]) if chosen else ():
                    code = g.codes(chosen)
                    known = code >= 0
                    held, tf = gr.runs(g.row[known] * len(chosen) + code[known])
                    total[b.name][0] += np.bincount(held % len(chosen), minlength=len(chosen))
                    total[b.name][1] += np.bincount(held % len(chosen), tf, len(chosen)).astype("int64")
        for name, chosen in sets.items():
            at = np.flatnonzero(total[name][1])
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(name), len(at)), pa.array(chosen, pa.string()).take(pa.array(at)), pa.array(total[name][0, at]), pa.array(total[name][1, at])],
                names=["block", "term", "df", "cf"])
    counted = unit_columns(texts, blocks).drop("doc_id").mapInArrow(run, "block string, term string, df long, cf long")
    return counted.groupBy("block", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


class TfidfVectorizer:
    """Estimator; ``fit`` returns a ``TfidfModel``.

    The vocabulary is exact either way.  By default every distinct term is counted: one scan, and an exchange that
    grows with the distinct terms of all tasks.  With ``counters`` tasks send summaries of that many terms per block;
    the most frequent terms by these are counted exactly in a second scan, and only they are exchanged.  Their bound
    tells whether a term outside could belong to the vocabulary; a block for which it could is counted in full."""

    def __init__(self, blocks: tuple[BlockSpec, ...] = LEDGER_BLOCKS, counters: int | None = None):
        self.blocks, self.counters = blocks, counters
        self.counted_in_full: list[str] = []

    def _top(self, stats: DataFrame, b: BlockSpec, n_docs: int) -> DataFrame:
        cand = stats.filter((F.col("block") == b.name) & (F.col("df") >= b.min_df))
        if b.max_df is not None:
            cand = cand.filter(F.col("df") <= F.lit(b.max_df * n_docs))
        return cand.orderBy(F.desc("cf"), F.asc("term")).limit(b.max_features).select("block", "term", "df", "cf")

    def _full(self, texts: DataFrame, blocks: tuple[BlockSpec, ...], n_docs: int) -> list:
        """Vocabulary rows of ``blocks`` from a count of every distinct term."""
        stats = term_stats(texts, blocks)
        # written once for the per-block top-N selections, without the terms that no vocabulary may hold
        least = F.coalesce(*[F.when(F.col("block") == b.name, F.lit(b.min_df)) for b in blocks])
        stats = written(stats.filter(F.col("df") >= least), "term-stats")
        kept = self._top(stats, blocks[0], n_docs)
        for b in blocks[1:]:
            kept = kept.unionByName(self._top(stats, b, n_docs))
        return kept.collect()

    def _summarised(self, texts: DataFrame, n_docs: int) -> list:
        """The same rows by summaries and an exact recount."""
        merged = written(summaries(texts, self.blocks, self.counters).groupBy("block", "term").agg(F.sum("low").alias("low")), "summaries")
        error = {r["block"]: r["low"] for r in merged.filter("term is null").collect()}
        terms, outside = {}, {}
        for b in self.blocks:
            room = 4 * b.max_features
            top = (merged.filter((F.col("block") == b.name) & F.col("term").isNotNull())
                   .orderBy(F.desc("low"), "term").limit(room + 1).collect())
            terms[b.name] = [r["term"] for r in top[:room]]
            outside[b.name] = error.get(b.name, 0) + (top[room]["low"] if len(top) > room else 0)
        stats = written(recount(texts, self.blocks, terms), "recount")
        rows, unsure = [], []
        for b in self.blocks:
            own = self._top(stats, b, n_docs).collect()
            least = min((r["cf"] for r in own), default=0) if len(own) == b.max_features else b.min_df
            if outside[b.name] < least:                        # no term outside occurs as often as is needed
                rows += own
            else:
                unsure.append(b)
        self.counted_in_full = [b.name for b in unsure]
        return rows + (self._full(texts, tuple(unsure), n_docs) if unsure else [])

    def fit(self, texts: DataFrame, n_docs: int | None = None) -> TfidfModel:
        if n_docs is None:
            n_docs = texts.count()
        # The fitted vocabulary is bounded by sum(max_features) rows; like a CountVectorizerModel it is materialised
        # once (driver-held), so later transforms do not recompute the fit lineage.
        rows = self._full(texts, self.blocks, n_docs) if self.counters is None else self._summarised(texts, n_docs)
        records, sizes, offset = [], {}, 0
        for b in self.blocks:
            terms = sorted((r for r in rows if r["block"] == b.name), key=lambda r: r["term"])
            for i, r in enumerate(terms):
                records.append((b.name, r["term"], int(r["df"]), int(r["cf"]), smooth_idf(n_docs, int(r["df"])), offset + i))
            sizes[b.name] = len(terms)
            offset += len(terms)
        vocab = texts.sparkSession.createDataFrame(
            records, "block string, term string, df long, cf long, idf double, col_index int")
        return TfidfModel(self.blocks, n_docs, vocab, sizes)


def smooth_idf(n_docs: int, df: int) -> float:
    return math.log((1 + n_docs) / (1 + df)) + 1.0
