"""Spelling variant grouping (operator 12): PartEnum signatures over letter multisets.

Words are maximal runs of Latin letters.  As a multiset of letters a word is a binary vector: one place per
(letter, how many of it so far).  One inserted or deleted letter changes one place, a replaced one two, so near
words have vectors at Hamming distance two at most.

 1. Count.  Runs of seven letters or more are counted over all texts (partial aggregate); rare ones go.
 2. Partition and enumerate.  The places are dealt into partitions by a hash.  Two vectors at distance k differ in k
    partitions at most, so they are equal on some choice of all but k of them; each word gives one exact signature
    per choice: a hash of the choice and of the places that lie in it.  Words of one length are near at distance two
    (four partitions, six choices), words of neighbouring lengths at distance one (three partitions, three choices).
    Many words share their letters, so a signature also holds the lengths and a half of the word: the edit lies in
    one half and leaves the letters of the other as they are, in their order.
 3. Equi-join of equal signatures, and in the same join the verification: words of the pair differ by exactly
    one code point.  Only verified pairs leave the join; hot signatures are split by adaptive execution.
 4. A word's form is its most frequent near word, if that is ``ratio`` times as frequent.  Frequencies along
    forms rise by that factor, so there are no cycles; roots are found by pointer doubling.

Null text: no words.  Null doc_id: the text of the id is empty.  Repeated rows count again.  Ties between forms
go to the smallest in code-point order.  Very long texts are handled whole.  An empty table gives an empty result.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import ascii_lower, table, written
from ledgerlens.llm.words import mix64

# Fixed values of the task: letters of a run, smallest word, smallest count, typo rule, dominance of a form.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, TYPO, RATIO = 7, 2, 31, 10
PARTS, PARTS_NEXT = 4, 3         # partitions for words of the same length, of neighbouring lengths
_SEED = np.uint64(0xA0761D6478BD642F)


def with_typo(doc_id: Column, run: Column, every: int = TYPO) -> Column:
    """The run, without its code point h % length if ``every`` divides h, the crc32 of '<doc_id>:<run>'."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of at least ``length`` code points that occur at least ``count`` times."""
    # a run that is too short gives no word, with a typo or without; a longer one is matched as a whole
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"([{LETTERS}]{{{length},}})"), F.lit(1))
    found = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", ascii_lower(F.col("run")).alias("run"))
    return (found.select(with_typo(F.col("doc_id"), F.col("run")).alias("word")).filter(F.length("word") >= length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= count))


def part_sums(words: list[str], parts: int) -> np.ndarray:
    """(words, parts) sums of hashed places: equal vectors on a partition have equal sums."""
    out = np.zeros((len(words), parts), np.uint64)
    size = np.array([len(w) for w in words], np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        letters = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), n)
        letters = np.sort(letters, axis=1).astype(np.uint64)
        turn = np.zeros_like(letters)                          # how many of this letter came before
        for j in range(1, n):
            turn[:, j] = np.where(letters[:, j] == letters[:, j - 1], turn[:, j - 1] + np.uint64(1), np.uint64(0))
        place = mix64((letters << np.uint64(32)) + turn + _SEED)
        part, value = (place >> np.uint64(40)) % np.uint64(parts), mix64(place ^ _SEED)
        for p in range(parts):
            out[at, p] = np.where(part == p, value, np.uint64(0)).sum(1, dtype=np.uint64)
    return out


def half_hashes(words: list[str]) -> np.ndarray:
    """(words, 6) hashes of halves with the lengths they are for: first and last half among words of the same length;
    the same as the shorter one of a pair; as the longer one."""
    out = np.zeros((len(words), 6), np.uint64)
    size = np.array([len(w) for w in words], np.int64)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        letters = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), n).astype(np.uint64)
        h, g = n // 2, (n - 1) // 2
        halves = ((letters[:, :h], 4 * n), (letters[:, h:], 4 * n + 1), (letters[:, :h], 4 * n + 2), (letters[:, h:], 4 * n + 3),
                  (letters[:, :g], 4 * (n - 1) + 2), (letters[:, g + 1:], 4 * (n - 1) + 3))
        for k, (part, seed) in enumerate(halves):
            total = np.full(len(at), seed, np.uint64)
            for j in range(part.shape[1]):
                total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + part[:, j])
            out[at, k] = total
    return out


def enumerated(sums: np.ndarray, apart: int) -> list[np.ndarray]:
    """One hash per choice of all but ``apart`` partitions; ``sums`` is (words, partitions)."""
    total = sums.sum(1, dtype=np.uint64)
    out = []
    for i, away in enumerate(combinations(range(sums.shape[1]), apart)):
        left = total - sums[:, list(away)].sum(1, dtype=np.uint64)
        out.append(mix64(left ^ mix64(np.full(1, 1000 * apart + i + 1, np.uint64))))
    return out


def signatures(words: list[str], parts: int = PARTS, parts_next: int = PARTS_NEXT) -> np.ndarray:
    """(words, signatures) of each word."""
    half = half_hashes(words)
    same = [mix64(e ^ half[:, k]) for e in enumerated(part_sums(words, parts), 2) for k in (0, 1)]
    return np.stack(same + [mix64(e ^ half[:, k]) for e in enumerated(part_sums(words, parts_next), 1) for k in (2, 3, 4, 5)], 1)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, na, nb), a < b: the words that differ by exactly one code point, once each; ``words`` is (word, n)."""
    def sign(it):
        for b in it:
            sig = signatures(b["word"].to_pylist())
            again = pa.array(np.repeat(np.arange(b.num_rows), sig.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(sig.reshape(-1).view(np.int64)), b["word"].take(again), b["n"].take(again)],
                                             names=["s", "word", "n"])
    signed = words.mapInArrow(sign, "s long, word string, n long")
    a, b = signed.alias("a"), signed.alias("b")               # the same exchange serves both sides
    near = (F.col("a.word") < F.col("b.word")) & (F.levenshtein("a.word", "b.word", 1) == 1)
    return a.join(b, (F.col("a.s") == F.col("b.s")) & near).select(
        F.col("a.word").alias("a"), F.col("b.word").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last form that is reached, by pointer doubling."""
    ptr = written(forms.select("word", F.col("form").alias("to")), "spelling-ptr")
    while True:
        on = ptr.select(F.col("word").alias("at"), F.col("to").alias("further"))
        step = written(ptr.join(on, F.col("to") == F.col("at"), "left").select(
            "word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "spelling-step")
        ptr = step.select("word", "to")
        if step.filter("moved").isEmpty():
            return ptr.withColumnRenamed("to", "root")


def spelling_variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``docs`` (doc_id, text)."""
    words = written(word_counts(docs.select("doc_id", "text")), "spelling-words")
    pairs = written(near_pairs(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("w"), F.col("b").alias("v"), F.col("nb").alias("nv")).union(
        pairs.select(F.col("b").alias("w"), F.col("a").alias("v"), F.col("na").alias("nv")))
    best = both.groupBy("w").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("nv"), F.col("v"))).alias("best"))
    found = (words.join(best, F.col("word") == F.col("w"), "left")
             .withColumn("leads", F.coalesce(-F.col("best.col1") >= ratio * F.col("n"), F.lit(False)))
             .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                     F.when(F.col("leads"), F.col("best.v")).alias("form"), F.when(F.col("leads"), -F.col("best.col1")).alias("form_n")))
    found = written(found, "spelling-forms")
    end = roots(found.filter("form is not null")).withColumnRenamed("word", "w")
    return found.join(end, F.col("word") == F.col("w"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


#: crc32 by table (from its polynomial); near words by equal remainders after one deletion.
OP12_SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
    FROM (SELECT unnest(range(256))::BIGINT AS i)),
u AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
v AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM u WHERE length(run) >= 7),
k AS (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS b FROM v GROUP BY doc_id, run),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT,
        [('0x' || b[2 * i - 1:2 * i])::BIGINT FOR i IN range(1, length(b) // 2 + 1)]),
        lambda c, x: xor(c // 256, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM k, crc),
w AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 31 = 0
        THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM h)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
d AS MATERIALIZED (SELECT DISTINCT word, n, p, word[1:p] || word[p + 2:] AS rest
    FROM (SELECT word, n, unnest(range(length(word))) AS p FROM w)),
near AS MATERIALIZED (SELECT DISTINCT a.word AS w, b.word AS v, b.n AS nv FROM d a JOIN w b ON a.rest = b.word
    UNION SELECT DISTINCT b.word, a.word, a.n FROM d a JOIN w b ON a.rest = b.word
    UNION SELECT DISTINCT a.word, b.word, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word),
best AS (SELECT w, count(*) AS n_near, max(nv) AS form_n, arg_min(v, {'n': -nv, 'v': v}) AS form FROM near GROUP BY w),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form,
    CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM w LEFT JOIN best ON word = w),
r AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL
    UNION SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
last AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, coalesce(last.root, f.word) AS root FROM f LEFT JOIN last ON f.word = last.word
"""


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
