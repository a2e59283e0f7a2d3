"""Registered queries, part two: text vectorisation, evaluation, monitoring,
payloads and explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluate as ev
from ..operators import explain as xp
from ..operators import normalize as nz
from ..operators import tfidf as tf
from ..sources.ledger import read_tables
from ..sources.payload import parse_payload, payload_violations
from . import oracle as O
from .catalog import labelled_ledger, once, prepared, query, r6, split_ledger, ts_text

# ====================================================================== text
_SQL_WORDS = "regexp_extract_all({t}, '[a-z0-9œæ]{{2,}}')"
_SQL_DOC_WORDS = _SQL_WORDS.format(t=O.sql_strip_accents(O.sql_normalize("text")))


def _sql_ngrams12(toks: str) -> str:
    return (f"list_concat({toks}, list_transform(range(1, len({toks})), "
            f"lambda i: {toks}[i] || ' ' || {toks}[i + 1]))")


def _sql_char_wb(text: str) -> str:
    per_n = ", ".join(
        f"list_transform(range(1, greatest(length(' ' || w || ' ') - {n} + 2, 1)), "
        f"lambda i: substring(' ' || w || ' ', i, {n}))" for n in (3, 4, 5))
    return (f"flatten(list_transform(list_filter(string_split({text}, ' '), lambda x: x <> ''), "
            f"lambda w: flatten([{per_n}])))")


@query("text_clean", O.prepared_sql(f"""
SELECT txn_id AS doc_id, {O.sql_normalize('description')} AS "desc",
       {O.sql_normalize(O.sql_strip_html('remarks'))} AS rem,
       {O.sql_normalize('description')} || ' ' || {O.sql_normalize(O.sql_strip_html('remarks'))} AS chr
FROM prepared"""))
def q_text_clean(spark, sf):
    return tf.ledger_texts(prepared(spark, sf))


@query("word_tokens", f"""
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, ' ') AS tokens
FROM (SELECT doc_id, {_SQL_DOC_WORDS} AS toks FROM documents)""")
def q_word_tokens(spark, sf):
    docs = read_tables(spark, sf, "documents")["documents"]
    toks = tx.word_tokens(tx.strip_accents(tx.normalize_text("text")))
    return docs.select("doc_id", toks.alias("toks")).select(
        "doc_id", F.size("toks").alias("n_tokens"), F.array_join("toks", " ").alias("tokens"))


def _document_stats(spark, sf, block: tf.BlockSpec) -> DataFrame:
    """Document and corpus frequency of every n-gram of the documents."""
    docs = read_tables(spark, sf, "documents")["documents"]
    return tf.id_stats(docs.select("doc_id", tx.normalize_text("text").alias(block.name)), (block,))


@query("word_ngrams", f"""
SELECT ngram, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (
  SELECT doc_id, unnest({_sql_ngrams12('toks')}) AS ngram
  FROM (SELECT doc_id, {_SQL_DOC_WORDS} AS toks FROM documents)) GROUP BY ngram""")
def q_word_ngrams(spark, sf):
    return _document_stats(spark, sf, tf.BlockSpec("text", 0, (1, 2))).select(F.col("term").alias("ngram"), "df", "cf")


@query("char_ngrams", f"""
SELECT gram, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (
  SELECT doc_id, unnest({_sql_char_wb(O.sql_normalize('text'))}) AS gram FROM documents)
GROUP BY gram""")
def q_char_ngrams(spark, sf):
    return _document_stats(spark, sf, tf.BlockSpec("text", 0, (3, 5), "char_wb")).select(F.col("term").alias("gram"), "df", "cf")


# ---- ledger TF-IDF fitted on the training part --------------------------
def _ledger_tfidf(spark, sf):
    """(vocabularies of the training part, all texts); fitted once for the queries that read them."""
    tr, va = split_ledger(spark, sf)
    return ledger_vocabularies(spark, sf), tf.ledger_texts(tr.unionByName(va))


def ledger_vocabularies(spark, sf) -> tf.TfidfModel:
    """Vocabularies of the training part, fitted once for all queries and models."""
    return once(spark, sf, "tfidf", lambda: tf.TfidfVectorizer().fit(tf.ledger_texts(split_ledger(spark, sf)[0])))


_SQL_TEXTS = f"""
, texts AS (SELECT txn_id AS doc_id, part, {O.sql_normalize('description')} AS d,
                   {O.sql_normalize(O.sql_strip_html('remarks'))} AS r FROM labelled),
terms AS (
  SELECT doc_id, part, 'desc' AS block,
         unnest({_sql_ngrams12(_SQL_WORDS.format(t=O.sql_strip_accents('d')))}) AS term FROM texts
  UNION ALL
  SELECT doc_id, part, 'rem', unnest({_sql_ngrams12(_SQL_WORDS.format(t=O.sql_strip_accents('r')))})
  FROM texts
  UNION ALL
  SELECT doc_id, part, 'chr', unnest({_sql_char_wb("d || ' ' || r")}) FROM texts),
tfs AS (SELECT doc_id, part, block, term, count(*) AS tf FROM terms GROUP BY ALL),
ndocs AS (SELECT count(*) AS n FROM labelled WHERE part = 'train'),
stats AS (SELECT block, term, count(*) AS df, sum(tf) AS cf FROM tfs WHERE part = 'train'
          GROUP BY ALL),
cand AS (SELECT s.*, row_number() OVER (PARTITION BY block ORDER BY cf DESC, term) AS rk
         FROM stats s, ndocs
         WHERE df >= 3 AND (block = 'chr' OR df <= CAST(0.95 AS DOUBLE) * n)),
kept AS (SELECT block, term, df, cf FROM cand
         WHERE rk <= CASE block WHEN 'chr' THEN 1000 ELSE 4000 END),
sizes AS (SELECT block, count(*) AS k FROM kept GROUP BY block),
offs AS (SELECT block, coalesce(sum(k) OVER (ORDER BY CASE block WHEN 'desc' THEN 0
                 WHEN 'rem' THEN 1 ELSE 2 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 AS off FROM sizes),
vocab AS (SELECT kept.block, term, df, cf,
                 ln((1 + (SELECT n FROM ndocs)) / (1 + df)) + 1 AS idf,
                 CAST(off + row_number() OVER (PARTITION BY kept.block ORDER BY term) - 1 AS INTEGER)
                   AS col_index
          FROM kept JOIN offs USING (block)),
weights AS (SELECT doc_id, block, term, col_index,
                   (1 + ln(tf)) * idf AS w FROM tfs JOIN vocab USING (block, term)),
normed AS (SELECT doc_id, block, term, col_index,
                  w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, block)) AS weight FROM weights)"""


def _tfidf_sql(body: str) -> str:
    return O.split_sql(_SQL_TEXTS + "\n" + body).replace("\n, texts", ", texts", 1)


@query("tfidf_vocab", _tfidf_sql("SELECT block, term, df, cf, col_index FROM vocab"))
def q_tfidf_vocab(spark, sf):
    model, _ = _ledger_tfidf(spark, sf)
    return model.vocab.select("block", "term", "df", "cf", "col_index")


@query("tfidf_vocab_summaries", _tfidf_sql("SELECT block, term, df, cf, col_index FROM vocab"))
def q_tfidf_vocab_summaries(spark, sf):
    """A9 / T5 by mergeable summaries and an exact recount: the same vocabularies."""
    model = tf.TfidfVectorizer(counters=20_000).fit(tf.ledger_texts(split_ledger(spark, sf)[0]))
    return model.vocab.select("block", "term", "df", "cf", "col_index")


@query("tfidf_idf", _tfidf_sql("SELECT block, term, round(idf, 6) AS idf FROM vocab"))
def q_tfidf_idf(spark, sf):
    model, _ = _ledger_tfidf(spark, sf)
    return model.vocab.select("block", "term", r6(F.col("idf")).alias("idf"))


@query("tfidf_names", _tfidf_sql(
    "SELECT col_index, block || '_' || term AS name FROM vocab"))
def q_tfidf_names(spark, sf):
    model, _ = _ledger_tfidf(spark, sf)
    return model.feature_names()


@query("tfidf_weights", _tfidf_sql(
    "SELECT doc_id, block, term, round(weight, 6) AS weight FROM normed"))
def q_tfidf_weights(spark, sf):
    model, texts = _ledger_tfidf(spark, sf)
    w = model.transform(texts)
    return w.select("doc_id", "block", "term", r6(F.col("weight")).alias("weight"))


@query("tfidf_char_norms", _tfidf_sql("""
SELECT doc_id, count(*) AS n_terms, round(sum(weight * weight), 6) AS sum_sq,
       round(max(weight), 6) AS max_weight
FROM normed WHERE block = 'chr' GROUP BY doc_id"""))
def q_tfidf_char_norms(spark, sf):
    model, texts = _ledger_tfidf(spark, sf)
    w = model.transform(texts, ("chr",), ("doc_id", "weight"))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"),
                                   r6(F.sum(F.col("weight") * F.col("weight"))).alias("sum_sq"),
                                   r6(F.max("weight")).alias("max_weight"))


@query("doc_top_terms", f"""
WITH words AS (SELECT doc_id, {_SQL_DOC_WORDS} AS w FROM documents),
toks AS (SELECT doc_id, unnest({_sql_ngrams12('w')}) AS term FROM words),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
stats AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tfs GROUP BY term),
vocab AS (SELECT term, ln((1 + (SELECT n FROM n)) / (1 + df)) + 1 AS idf FROM stats
          WHERE df >= 3 AND df <= CAST(0.95 AS DOUBLE) * (SELECT n FROM n)
          ORDER BY cf DESC, term LIMIT 4000),
w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tfs JOIN vocab USING (term)),
nw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM nw)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, term, round(weight, 6) AS weight FROM rk WHERE rank <= 5""")
def q_doc_top_terms(spark, sf):
    """Top-5 TF-IDF terms per document (word 1-2-grams, vocabulary of 4,000)."""
    docs = read_tables(spark, sf, "documents")["documents"]
    block = tf.BlockSpec("text", 4000, (1, 2))
    texts = docs.select("doc_id", tx.normalize_text("text").alias("text"))
    model = tf.TfidfVectorizer((block,)).fit(texts)
    return model.top_terms(texts, 5).select("doc_id", "rank", "term", r6(F.col("weight")).alias("weight"))


# ================================================================ evaluation
def class_scores(embedding: str, n: int = 10) -> Column:
    """Score of class i: the sum of all values whose index modulo ``n`` is i."""
    every = F.transform(F.col(embedding).cast("array<double>"), lambda x, j: F.struct(x.alias("x"), (j % n).alias("c")))
    return F.transform(F.array_repeat(every, n), lambda vs, i: F.aggregate(
        vs, F.lit(0.0), lambda acc, v: acc + F.when(v["c"] == i, v["x"]).otherwise(0.0)))


def emb_predictions(spark, sf) -> DataFrame:
    """Ten class scores from all embedding values; probabilities by softmax."""
    e = read_tables(spark, sf, "embeddings")["embeddings"]
    return (e.select("vec_id", F.col("label").alias("y_true"), class_scores("embedding").alias("s"))
             .select("vec_id", "y_true", ev.softmax(F.col("s")).alias("proba"))
             .withColumn("y_pred", ev.argmax(F.col("proba"))))


EMB_CTE = """
WITH emb AS (SELECT vec_id, label AS y_true, list_transform(range(0, 10), lambda i: list_sum(list_transform(range(i, len(embedding), 10), lambda j: CAST(embedding[j + 1] AS DOUBLE)))) AS s FROM embeddings),
sm AS (SELECT vec_id, y_true, list_transform(s, lambda x: exp(x - list_max(s))) AS ex FROM emb),
pr AS (SELECT vec_id, y_true, list_transform(ex, lambda x: x / list_sum(ex)) AS proba FROM sm),
pred AS (SELECT vec_id, y_true, proba,
                CAST(list_position(proba, list_max(proba)) - 1 AS INTEGER) AS y_pred FROM pr),
cls AS (
  SELECT cls, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted,
         coalesce(tp, 0) AS tp FROM
  (SELECT y_true AS cls, count(*) AS support, sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS tp
     FROM pred GROUP BY 1) a
  FULL OUTER JOIN (SELECT y_pred AS cls, count(*) AS predicted FROM pred GROUP BY 1) b USING (cls)),
pc AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM cls),
pcf AS (SELECT *, CASE WHEN precision + recall > 0
                  THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pc),
ranks AS (SELECT vec_id, y_true, 1 + len(list_filter(proba, lambda x: x > proba[y_true + 1])) AS r
          FROM pred)
"""


@query("topk_codes", EMB_CTE + """
, u AS (SELECT vec_id, unnest(proba) AS p, unnest(generate_series(0, len(proba) - 1)) AS idx FROM pred),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, idx) AS rank FROM u)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(idx AS INTEGER) AS class_index,
       'C' || lpad(CAST(idx AS VARCHAR), 3, '0') AS code, round(p, 4) AS confidence
FROM r WHERE rank <= 3""".replace("\n, u AS", ", u AS", 1))
def q_topk_codes(spark, sf):
    pred = emb_predictions(spark, sf)
    best = pred.select("vec_id", F.posexplode(ev.top_k(F.col("proba"), 3)).alias("pos", "s"))
    return best.select("vec_id", (F.col("pos") + 1).cast("int").alias("rank"),
                       F.col("s.idx").alias("class_index"),
                       F.concat(F.lit("C"), F.lpad(F.col("s.idx").cast("string"), 3, "0")).alias("code"),
                       F.round("s.p", 4).alias("confidence"))


@query("argmax_class", EMB_CTE + """
SELECT vec_id, y_pred AS predicted, round(list_max(proba), 4) AS confidence FROM pred""")
def q_argmax_class(spark, sf):
    pred = emb_predictions(spark, sf)
    return pred.select("vec_id", F.col("y_pred").alias("predicted"),
                       F.round(F.array_max("proba"), 4).alias("confidence"))


@query("topk_accuracy", EMB_CTE + """
SELECT k, avg(CASE WHEN r <= k THEN 1.0 ELSE 0.0 END) AS accuracy
FROM ranks, (VALUES (1), (3), (5), (10)) t(k) GROUP BY k""")
def q_topk_accuracy(spark, sf):
    return ev.topk_accuracy(emb_predictions(spark, sf), n_classes=10)


@query("confusion_pairs", EMB_CTE + "SELECT y_true, y_pred, count(*) AS n FROM pred GROUP BY ALL")
def q_confusion_pairs(spark, sf):
    return ev.confusion_pairs(emb_predictions(spark, sf))


@query("classification_report", EMB_CTE + """
SELECT sum(tp) / sum(support) AS accuracy,
       avg(recall) FILTER (WHERE support > 0) AS balanced_accuracy,
       avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted,
       avg(precision) AS precision_macro,
       sum(precision * support) / sum(support) AS precision_weighted,
       avg(recall) AS recall_macro, sum(recall * support) / sum(support) AS recall_weighted
FROM pcf""")
def q_classification_report(spark, sf):
    return ev.classification_report(emb_predictions(spark, sf))


@query("per_class_performance", EMB_CTE + """
SELECT cls, support, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pcf
WHERE cls IN (SELECT y_true FROM pred GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20)""")
def q_per_class_performance(spark, sf):
    out = ev.per_class_performance(emb_predictions(spark, sf), top_n=20)
    return out.select("cls", "support", r6(F.col("precision")).alias("precision"),
                      r6(F.col("recall")).alias("recall"))


@query("confusion_matrix", EMB_CTE + """
, top AS (SELECT CAST(y_true AS VARCHAR) AS cls FROM pred GROUP BY y_true
          ORDER BY count(*) DESC, y_true LIMIT 5),
labels AS (SELECT cls FROM top UNION ALL SELECT 'Other'),
mapped AS (SELECT CASE WHEN CAST(y_true AS VARCHAR) IN (SELECT cls FROM top)
                       THEN CAST(y_true AS VARCHAR) ELSE 'Other' END AS t,
                  CASE WHEN CAST(y_pred AS VARCHAR) IN (SELECT cls FROM top)
                       THEN CAST(y_pred AS VARCHAR) ELSE 'Other' END AS p FROM pred),
counts AS (SELECT t, p, count(*) AS n FROM mapped GROUP BY ALL)
SELECT a.cls AS y_true, b.cls AS y_pred, coalesce(n, 0) AS n
FROM labels a, labels b LEFT JOIN counts ON counts.t = a.cls AND counts.p = b.cls
""".replace("\n, top AS", ", top AS", 1))
def q_confusion_matrix(spark, sf):
    return ev.confusion_matrix(emb_predictions(spark, sf), top_n=5)


@query("class_distribution", EMB_CTE + """
SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, y_true) AS INTEGER) AS class_rank,
       y_true AS cls, count(*) AS n FROM pred GROUP BY y_true""")
def q_class_distribution(spark, sf):
    out = ev.class_distribution(emb_predictions(spark, sf))
    return out.withColumn("class_rank", F.col("class_rank").cast("int"))


def _calib_case(expr: str, close_last: bool) -> str:
    e = ev._edges(10)
    parts = []
    for i in range(10):
        hi = f"{expr} <= {e[i + 1]!r}" if (close_last and i == 9) else f"{expr} < {e[i + 1]!r}"
        parts.append(f"WHEN {expr} >= {e[i]!r} AND {hi} THEN {i}")
    return "CASE " + " ".join(parts) + " END"


_BINS_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"({i}, CAST({ev._edges(10)[i]!r} AS DOUBLE), CAST({ev._edges(10)[i + 1]!r} AS DOUBLE))"
    for i in range(10)) + ") t(bin, lo, hi))"


@query("calibration", EMB_CTE + f"""
, rows AS (SELECT {_calib_case('list_max(proba)', False)} AS bin, list_max(proba) AS conf,
                  CASE WHEN y_pred = y_true THEN 1.0 ELSE 0.0 END AS ok FROM pred),
g AS (SELECT bin, avg(ok) AS acc, avg(conf) AS mc, count(*) AS n FROM rows WHERE bin IS NOT NULL
      GROUP BY bin)
SELECT CAST(b.bin AS INTEGER) AS bin, round(coalesce(acc, 0.0), 6) AS accuracy,
       round(coalesce(mc, (lo + hi) / 2), 6) AS mean_confidence, coalesce(n, 0) AS n
FROM {_BINS_SQL} b LEFT JOIN g USING (bin)""".replace("\n, rows AS", ", rows AS", 1))
def q_calibration(spark, sf):
    out = ev.calibration(emb_predictions(spark, sf))
    return out.select("bin", r6(F.col("accuracy")).alias("accuracy"),
                      r6(F.col("mean_confidence")).alias("mean_confidence"), "n")


@query("confidence_histogram", EMB_CTE + f"""
, g AS (SELECT {_calib_case('list_max(proba)', True)} AS bin, count(*) AS n FROM pred GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, round(lo, 2) AS bin_lo, round(hi, 2) AS bin_hi,
       coalesce(n, 0) AS n FROM {_BINS_SQL} b LEFT JOIN g USING (bin)""".replace("\n, g AS", ", g AS", 1))
def q_confidence_histogram(spark, sf):
    pred = emb_predictions(spark, sf).select(F.array_max("proba").alias("confidence"))
    return ev.confidence_histogram(pred)


@query("confidence_summary", EMB_CTE + """
SELECT count(*) AS n_samples, round(avg(list_max(proba)), 4) AS mean_confidence,
       round(median(list_max(proba)), 4) AS median_confidence FROM pred""")
def q_confidence_summary(spark, sf):
    pred = emb_predictions(spark, sf).select(F.array_max("proba").alias("confidence"))
    return ev.confidence_summary(pred)


@query("metrics_summary", EMB_CTE + """
SELECT (SELECT sum(tp) / sum(support) FROM pcf) AS accuracy,
       (SELECT avg(recall) FILTER (WHERE support > 0) FROM pcf) AS balanced_accuracy,
       CAST(10 AS INTEGER) AS n_classes, (SELECT count(*) FROM pred) AS n_samples,
       (SELECT avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END) FROM ranks) AS top_1,
       (SELECT avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END) FROM ranks) AS top_3,
       (SELECT avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END) FROM ranks) AS top_5,
       (SELECT avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END) FROM ranks) AS top_10""")
def q_metrics_summary(spark, sf):
    pred = emb_predictions(spark, sf)
    rep = ev.classification_report(pred).select("accuracy", "balanced_accuracy")
    r = pred.select(ev.true_rank(F.col("proba"), F.col("y_true")).alias("r"))
    tops = r.agg(F.count(F.lit(1)).alias("n_samples"),
                 *[F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)).alias(f"top_{k}")
                   for k in ev.TOPK_VALUES])
    # both sides are single rows: a one-row equi-join on a constant key
    return (rep.withColumn("__k", F.lit(1)).join(tops.withColumn("__k", F.lit(1)), "__k")
               .drop("__k").withColumn("n_classes", F.lit(10)))


@query("quality_gate", EMB_CTE + """
, base AS (SELECT max(c) / sum(c) AS baseline_accuracy, count(*) AS n_classes
           FROM (SELECT y_true, count(*) AS c FROM pred GROUP BY 1)),
m AS (SELECT sum(tp) / sum(support) AS accuracy,
             avg(recall) FILTER (WHERE support > 0) AS balanced_accuracy FROM pcf)
SELECT coalesce(accuracy, 0.0) AS accuracy, coalesce(balanced_accuracy, 0.0) AS balanced_accuracy,
       baseline_accuracy, baseline_accuracy * CAST(1.2 AS DOUBLE) AS acc_threshold,
       (1.0 / greatest(n_classes, 1)) * CAST(1.2 AS DOUBLE) AS bal_threshold,
       CAST(CASE WHEN coalesce(accuracy, 0.0) >= baseline_accuracy * CAST(1.2 AS DOUBLE)
             AND coalesce(balanced_accuracy, 0.0) >= (1.0 / greatest(n_classes, 1)) * CAST(1.2 AS DOUBLE)
            THEN 1 ELSE 0 END AS INTEGER) AS passed
FROM m, base""".replace("\n, base AS", ", base AS", 1))
def q_quality_gate(spark, sf):
    pred = emb_predictions(spark, sf)
    base = nz.class_counts(pred, "y_true").agg(
        (F.max("n_rows") / F.sum("n_rows")).alias("baseline_accuracy"),
        F.count(F.lit(1)).alias("n_classes"))
    rep = ev.classification_report(pred)
    joined = rep.withColumn("__k", F.lit(1)).join(base.withColumn("__k", F.lit(1)), "__k")
    return ev.quality_gate(joined, F.col("baseline_accuracy"), F.col("n_classes"))


@query("label_decode", O.split_sql("""
, labels AS (SELECT target AS code, CAST(dense_rank() OVER (ORDER BY target) - 1 AS INTEGER) AS label
             FROM (SELECT DISTINCT target FROM labelled WHERE part = 'train')),
emb AS (SELECT vec_id, list_transform(range(0, 10), lambda i: list_sum(list_transform(range(i, len(embedding), 10), lambda j: CAST(embedding[j + 1] AS DOUBLE)))) AS s FROM embeddings)
SELECT vec_id, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS prediction, code
FROM emb LEFT JOIN labels ON labels.label = list_position(s, list_max(s)) - 1
""".replace("\n, labels AS", ", labels AS", 1)))
def q_label_decode(spark, sf):
    labels = nz.label_table(labelled_ledger(spark, sf).filter(F.col("part") == "train"))
    e = read_tables(spark, sf, "embeddings")["embeddings"]
    pred = e.select("vec_id", class_scores("embedding").alias("s")).select("vec_id", ev.argmax(F.col("s")).alias("prediction"))
    return nz.decode_labels(pred, labels, "prediction", "code").select("vec_id", "prediction", "code")


# ================================================================ monitoring
def event_confidence(spark, sf) -> DataFrame:
    ev_t = read_tables(spark, sf, "events")["events"]
    return ev_t.select(F.col("ts").cast("timestamp").alias("ts"), "event_type",
                       F.least(F.col("value") / 500.0, F.lit(1.0)).alias("confidence"))


@query("confidence_drift", f"""
WITH c AS (SELECT date_trunc('day', ts) AS w, least(value / 500.0, 1.0) AS confidence FROM events),
b AS (SELECT w, {_calib_case('confidence', True)} AS bin FROM c),
per_w AS (SELECT w, count(*) AS n, avg(confidence) AS mean_conf FROM c GROUP BY w),
per_wb AS (SELECT w, bin, count(*) AS nb FROM b GROUP BY ALL),
grid AS (SELECT w, n, unnest(range(0, 10)) AS bin FROM per_w),
shares AS (SELECT g.w, g.bin, coalesce(nb, 0) / n AS share FROM grid g
           LEFT JOIN per_wb p ON p.w = g.w AND p.bin = g.bin),
lagged AS (SELECT w, abs(share - lag(share) OVER (PARTITION BY bin ORDER BY w)) AS dd FROM shares),
d AS (SELECT w, sum(dd) AS l1 FROM lagged GROUP BY w)
SELECT strftime(per_w.w, '%Y-%m-%d %H:%M:%S') AS w, n, round(mean_conf, 6) AS mean_conf,
       round(l1, 6) AS l1_drift FROM per_w JOIN d USING (w)""")
def q_confidence_drift(spark, sf):
    return drift_columns(ev.confidence_drift(event_confidence(spark, sf)))


def drift_columns(out):
    return out.select(ts_text("w").alias("w"), "n", r6(F.col("mean_conf")).alias("mean_conf"),
                      r6(F.col("l1_drift")).alias("l1_drift"))


# ================================================================== payloads
def _event_payload_json() -> Column:
    return F.to_json(F.struct(
        F.col("event_type").alias("description"), F.col("props").alias("remarks"),
        F.col("value").alias("debit"),
        F.when(F.col("event_id") % 3 == 0, F.lit("n/a")).otherwise(F.col("user_id").cast("string"))
         .alias("credit"),
        F.date_format("ts", "yyyy-MM-dd").alias("posting_date"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("reference")))


@query("payload_parse", """
SELECT event_id, event_type AS description, props AS remarks, 'U' || CAST(user_id AS VARCHAR) AS reference,
       value AS debit, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE CAST(user_id AS DOUBLE) END AS credit,
       strftime(CAST(CAST(ts AS DATE) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS posting_date,
       CAST(json_extract(props, '$.k') AS BIGINT) AS k
FROM events""")
def q_payload_parse(spark, sf):
    e = read_tables(spark, sf, "events")["events"]
    wire = e.select("event_id", _event_payload_json().alias("payload"))
    p = parse_payload(wire, "payload", keep=["event_id"])
    return p.select("event_id", "description", "remarks", "reference", "debit", "credit",
                    ts_text("posting_date").alias("posting_date"),
                    F.get_json_object("remarks", "$.k").cast("bigint").alias("k"))


@query("payload_violations", """
SELECT doc_id, CAST(len(v) AS INTEGER) AS n_violations, array_to_string(v, ',') AS reasons FROM (
 SELECT doc_id, list_filter([CASE WHEN n_chars % 9 = 0 THEN 'description_required' END,
   CASE WHEN n_chars % 9 <> 0 AND length(text) > 1000 THEN 'description_too_long' END,
   CASE WHEN length(text || ' ' || text) > 5000 THEN 'remarks_too_long' END,
   CASE WHEN length(lang || ':' || source || ':' || text) > 200 THEN 'reference_too_long' END],
   lambda x: x IS NOT NULL) AS v FROM documents)""")
def q_payload_violations(spark, sf):
    d = read_tables(spark, sf, "documents")["documents"]
    rec = d.select("doc_id",
                   F.when(F.col("n_chars") % 9 == 0, F.lit(None)).otherwise(F.col("text"))
                    .alias("description"),
                   F.concat_ws(" ", "text", "text").alias("remarks"),
                   F.concat_ws(":", "lang", "source", "text").alias("reference"))
    v = payload_violations(rec)
    return rec.select("doc_id", F.size(v).cast("int").alias("n_violations"),
                      F.array_join(v, ",").alias("reasons"))


# =============================================================== explanation
@query("top_contributions", xp.top_contributions_sql())
def q_top_contributions(spark, sf):
    e = read_tables(spark, sf, "embeddings")["embeddings"]
    return xp.top_contributions_query(e)


@query("global_importance", xp.global_importance_sql())
def q_global_importance(spark, sf):
    e = read_tables(spark, sf, "embeddings")["embeddings"]
    return xp.global_importance_query(e)
