"""Registered queries: one Spark plan per operator of the inventory, each with its
independent SQL oracle where SQL can express it.

Every query reads the driver tables under ``sf_dir`` (or frames Spark derives
from them) in full; none runs on made-up input.  Float outputs are rounded
(6 places, 4 for reported confidences) so two engines can agree exactly.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import features as feat
from ..operators import normalize as nz
from ..operators import split as sp
from ..operators.profile import DomainFeatures, Profile
from ..session import written
from ..sources.ledger import ledger_frame, ledger_raw_frame, read_tables
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

MIN_CLASS_SAMPLES = 200
LEDGER_FILE_ROWS = 20_000       # rows of a file of the written ledger at most
TRAIN_RATIO = 0.8


_LOCK = threading.RLock()
_KEPT: dict = {}


def once(spark: SparkSession, sf: str, name, make):
    """``make()``, kept per application and data folder: what several queries read is fitted or written once."""
    key = (spark.sparkContext.applicationId, sf, name)
    with _LOCK:
        if key not in _KEPT:
            _KEPT[key] = make()
        return _KEPT[key]


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@lru_cache(maxsize=1)
def profile() -> Profile:
    return Profile.from_yaml()


def domain() -> DomainFeatures:
    return DomainFeatures(profile())


def ts_text(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return nz.prepare_ledger(ledger_raw_frame(spark, sf))


def ledger6(spark: SparkSession, sf: str) -> DataFrame:
    return nz.prepare_ledger(ledger_frame(spark, sf))


def labelled_ledger(spark: SparkSession, sf: str) -> DataFrame:
    led = ledger6(spark, sf)
    return sp.label_split(led, sp.find_boundary(led, TRAIN_RATIO))


def split_ledger(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(training part, validation part) of the ledger, which is built and written once for all model queries: the boundary
    is searched in what was written, and rows get their part as they are read."""
    def make():
        led = written(ledger6(spark, sf), "ledger", LEDGER_FILE_ROWS)
        return sp.label_split(led, sp.find_boundary(led, TRAIN_RATIO))
    lab = once(spark, sf, "ledger", make)
    return lab.filter(F.col("part") == "train"), lab.filter(F.col("part") == "val")


SQL_TS = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


def sql_ts(c: str) -> str:
    return SQL_TS.format(c=c)


# ===================================================================== sources
@query("src_ledger", O.ledger_sql("""
SELECT txn_id, account_code, substring(account_code, 1, 6) AS target, description, remarks,
       reference, debit, credit, strftime(posting_date, '%Y-%m-%d %H:%M:%S') AS posting_date
FROM ledger"""))
def q_src_ledger(spark, sf):
    led = ledger6(spark, sf)
    return led.select("txn_id", "account_code", "target", "description", "remarks", "reference",
                      "debit", "credit", ts_text("posting_date").alias("posting_date"))


# =============================================================== normalisation
@query("prepare_ledger", O.prepared_sql(f"""
, kept AS (SELECT target FROM prepared GROUP BY target HAVING count(*) >= {MIN_CLASS_SAMPLES})
SELECT txn_id, target, description, remarks, reference, debit, credit,
       strftime(posting_date, '%Y-%m-%d %H:%M:%S') AS posting_date
FROM prepared WHERE target IN (SELECT target FROM kept)""".replace("\n, kept", ", kept", 1)))
def q_prepare_ledger(spark, sf):
    df = nz.prepare_ledger(ledger_raw_frame(spark, sf), min_class_samples=MIN_CLASS_SAMPLES)
    return df.select("txn_id", "target", "description", "remarks", "reference", "debit", "credit",
                     ts_text("posting_date").alias("posting_date"))


@query("norm_amounts", O.prepared_sql("SELECT txn_id, debit, credit FROM prepared"))
def q_norm_amounts(spark, sf):
    return prepared(spark, sf).select("txn_id", "debit", "credit")


@query("norm_dates", O.prepared_sql(
    "SELECT txn_id, strftime(posting_date, '%Y-%m-%d %H:%M:%S') AS posting_date FROM prepared"))
def q_norm_dates(spark, sf):
    return prepared(spark, sf).select("txn_id", ts_text("posting_date").alias("posting_date"))


@query("norm_text_nulls", O.prepared_sql(
    "SELECT txn_id, description, remarks, reference FROM prepared"))
def q_norm_text_nulls(spark, sf):
    return prepared(spark, sf).select("txn_id", "description", "remarks", "reference")


@query("target_prefix", O.ledger_sql(
    "SELECT txn_id, account_code, substring(account_code, 1, 4) AS target FROM ledger"))
def q_target_prefix(spark, sf):
    return ledger_frame(spark, sf).select("txn_id", "account_code",
                                          nz.target_prefix("account_code", 4).alias("target"))


@query("guard_amounts", O.prepared_sql("""
SELECT count(*) AS n_rows,
       coalesce(max(CAST((debit <> 0 OR credit <> 0) AS INTEGER)), 0) AS has_amounts
FROM prepared"""))
def q_guard_amounts(spark, sf):
    return nz.ledger_checks(prepared(spark, sf))


@query("rare_class_filter", O.prepared_sql(f"""
SELECT target, count(*) AS n_rows FROM prepared GROUP BY target
HAVING count(*) >= {MIN_CLASS_SAMPLES}"""))
def q_rare_class_filter(spark, sf):
    kept = nz.filter_rare_classes(prepared(spark, sf), MIN_CLASS_SAMPLES)
    return nz.class_counts(kept)


@query("drop_undated", O.prepared_sql("""
SELECT target, count(posting_date) AS n_dated, count(*) - count(posting_date) AS n_undated
FROM prepared GROUP BY target"""))
def q_drop_undated(spark, sf):
    df = prepared(spark, sf)
    return df.groupBy("target").agg(
        F.count("posting_date").alias("n_dated"),
        (F.count(F.lit(1)) - F.count("posting_date")).alias("n_undated"))


@query("class_frequency", O.ledger_sql(
    "SELECT substring(account_code, 1, 6) AS target, count(*) AS n_rows FROM ledger GROUP BY 1"))
def q_class_frequency(spark, sf):
    return nz.class_counts(ledger6(spark, sf))


# ====================================================================== split
@query("temporal_split", O.split_sql("SELECT txn_id, part FROM labelled"))
def q_temporal_split(spark, sf):
    return labelled_ledger(spark, sf).select("txn_id", "part")


@query("split_stats", O.split_sql("""
, cls AS (SELECT target, count(*) FILTER (WHERE part = 'train') AS n_train,
                 count(*) FILTER (WHERE part = 'val') AS n_val FROM labelled GROUP BY target)
SELECT (SELECT count(*) FROM labelled) AS total_rows,
       (SELECT count(*) FROM labelled WHERE part = 'train') AS train_rows,
       (SELECT count(*) FROM labelled WHERE part = 'val') AS val_rows,
       (SELECT count(*) FILTER (WHERE part = 'train') / count(*) FROM labelled) AS train_fraction,
       (SELECT count(*) FILTER (WHERE part = 'val') / count(*) FROM labelled) AS val_fraction,
       (SELECT count(DISTINCT target) FROM labelled WHERE part = 'train') AS train_n_classes,
       (SELECT count(DISTINCT target) FROM labelled WHERE part = 'val') AS val_n_classes,
       (SELECT strftime(min(posting_date), '%Y-%m-%d %H:%M:%S') FROM labelled WHERE part = 'train') AS train_first,
       (SELECT strftime(max(posting_date), '%Y-%m-%d %H:%M:%S') FROM labelled WHERE part = 'train') AS train_last,
       (SELECT strftime(min(posting_date), '%Y-%m-%d %H:%M:%S') FROM labelled WHERE part = 'val') AS val_first,
       (SELECT strftime(max(posting_date), '%Y-%m-%d %H:%M:%S') FROM labelled WHERE part = 'val') AS val_last,
       (SELECT count(*) FROM cls WHERE n_train > 0 AND n_val > 0) AS shared_classes,
       (SELECT count(*) FROM cls WHERE n_train > 0 AND n_val = 0) AS train_exclusive_classes,
       (SELECT count(*) FROM cls WHERE n_train = 0 AND n_val > 0) AS val_exclusive_classes,
       (SELECT coalesce(sum(n_val) FILTER (WHERE n_train > 0) / nullif(sum(n_val), 0), 0.0)
          FROM cls) AS val_coverage,
       CAST(0 AS BIGINT) AS n_undated""".replace("\n, cls", ", cls", 1)))
def q_split_stats(spark, sf):
    return sp.split_stats(labelled_ledger(spark, sf))


@query("split_undated", O.raw_split_sql("""
SELECT txn_id, part FROM labelled"""))
def q_split_undated(spark, sf):
    """W1 + P9 on the ledger as delivered: rows without a readable date are in neither part."""
    led = prepared(spark, sf)
    return sp.label_split(led, sp.find_boundary(led, TRAIN_RATIO)).select("txn_id", "part")


@query("split_stats_undated", O.raw_split_sql("""
SELECT (SELECT count(*) FROM labelled) AS total_rows,
       (SELECT count(*) FROM labelled WHERE part = 'train') AS train_rows,
       (SELECT count(*) FROM labelled WHERE part = 'val') AS val_rows,
       (SELECT count(*) FROM prepared WHERE posting_date IS NULL) AS n_undated"""))
def q_split_stats_undated(spark, sf):
    """M6 with rows that carry no readable date."""
    led = prepared(spark, sf)
    undated = led.filter(F.col("posting_date").isNull()).count()
    lab = sp.label_split(led, sp.find_boundary(led, TRAIN_RATIO))
    return sp.split_stats(lab, undated).select("total_rows", "train_rows", "val_rows", "n_undated")


@query("classes_shared", O.split_sql("""
SELECT target FROM labelled WHERE part = 'train' INTERSECT
SELECT target FROM labelled WHERE part = 'val'"""))
def q_classes_shared(spark, sf):
    return sp.classes_shared(labelled_ledger(spark, sf))


@query("classes_train_only", O.split_sql("""
SELECT target FROM labelled WHERE part = 'train' EXCEPT
SELECT target FROM labelled WHERE part = 'val'"""))
def q_classes_train_only(spark, sf):
    return sp.classes_train_only(labelled_ledger(spark, sf))


@query("classes_val_only", O.split_sql("""
SELECT target FROM labelled WHERE part = 'val' EXCEPT
SELECT target FROM labelled WHERE part = 'train'"""))
def q_classes_val_only(spark, sf):
    return sp.classes_val_only(labelled_ledger(spark, sf))


@query("known_class_filter", O.split_sql("""
SELECT txn_id, target FROM labelled v WHERE part = 'val'
AND target IN (SELECT target FROM labelled WHERE part = 'train')"""))
def q_known_class_filter(spark, sf):
    lab = labelled_ledger(spark, sf)
    tr, va = lab.filter(F.col("part") == "train"), lab.filter(F.col("part") == "val")
    return nz.keep_known_classes(va, tr).select("txn_id", "target")


@query("unseen_class_rows", O.split_sql("""
SELECT txn_id, target FROM labelled v WHERE part = 'val'
AND target NOT IN (SELECT target FROM labelled WHERE part = 'train')"""))
def q_unseen_class_rows(spark, sf):
    lab = labelled_ledger(spark, sf)
    tr, va = lab.filter(F.col("part") == "train"), lab.filter(F.col("part") == "val")
    return nz.unseen_class_rows(va, tr).select("txn_id", "target")


@query("majority_baseline", O.split_sql("""
SELECT max(c) / sum(c) AS baseline_accuracy, CAST(count(*) AS INTEGER) AS n_classes
FROM (SELECT target, count(*) AS c FROM labelled WHERE part = 'train' GROUP BY target)"""))
def q_majority_baseline(spark, sf):
    tr = labelled_ledger(spark, sf).filter(F.col("part") == "train")
    c = nz.class_counts(tr)
    return c.agg((F.max("n_rows") / F.sum("n_rows")).alias("baseline_accuracy"),
                 F.count(F.lit(1)).cast("int").alias("n_classes"))


@query("label_encode", O.split_sql("""
SELECT target AS code, CAST(dense_rank() OVER (ORDER BY target) - 1 AS INTEGER) AS label
FROM (SELECT DISTINCT target FROM labelled WHERE part = 'train')"""))
def q_label_encode(spark, sf):
    tr = labelled_ledger(spark, sf).filter(F.col("part") == "train")
    return nz.label_table(tr)


# ================================================================== features
@query("date_modes", O.prepared_sql("""
, parts AS (SELECT isodow(posting_date) - 1 AS weekday, day(posting_date) AS month_day,
                   month(posting_date) AS month, quarter(posting_date) AS quarter
            FROM prepared WHERE posting_date IS NOT NULL)
SELECT (SELECT weekday FROM parts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS weekday,
       (SELECT month_day FROM parts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS month_day,
       (SELECT month FROM parts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS month,
       (SELECT quarter FROM parts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS quarter
""".replace("\n, parts", ", parts", 1)))
def q_date_modes(spark, sf):
    parts = prepared(spark, sf).select(*feat.calendar_parts())
    return parts.agg(*[F.mode(c, True).cast("bigint").alias(c) for c in feat.CALENDAR_PARTS])


_BUCKET_SQL = ("CAST(CASE WHEN {a} IS NULL OR isnan({a}) THEN 0 "
               + " ".join(f"WHEN {{a}} <= {e!r} THEN {i}" for i, e in enumerate(feat.AMOUNT_EDGES))
               + f" ELSE {len(feat.AMOUNT_EDGES)} END AS INTEGER)")


@query("numeric_features", O.prepared_sql(f"""
SELECT txn_id, debit + credit AS amount, round(ln(1 + debit + credit), 6) AS log_amount,
 CAST(CASE WHEN debit > 0 THEN 1 ELSE 0 END AS INTEGER) AS is_debit,
 CAST(CASE WHEN credit > 0 THEN 1 ELSE 0 END AS INTEGER) AS is_credit,
 {_BUCKET_SQL.format(a='(debit + credit)')} AS amount_bucket,
 CAST(length(description) AS INTEGER) AS desc_len, CAST(length(remarks) AS INTEGER) AS remarks_len,
 CAST(CASE WHEN reference IS NOT NULL AND reference <> '' AND reference <> 'NULL' THEN 1 ELSE 0 END
      AS INTEGER) AS has_reference
FROM prepared"""))
def q_numeric_features(spark, sf):
    df = feat.numeric_features(prepared(spark, sf), keep=["txn_id"])
    return df.withColumn("log_amount", r6(F.col("log_amount")))


@query("amount_bucket", f"""
SELECT {_BUCKET_SQL.format(a='l_extendedprice')} AS amount_bucket, count(*) AS n_rows,
       sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS total_cents
FROM lineitem GROUP BY 1""")
def q_amount_bucket(spark, sf):
    li = read_tables(spark, sf, "lineitem")["lineitem"]
    return (li.groupBy(feat.amount_bucket("l_extendedprice").alias("amount_bucket"))
              .agg(F.count(F.lit(1)).alias("n_rows"),
                   F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
                   .alias("total_cents")))


def _date_feature_sql() -> str:
    two_pi = "(2 * pi())"
    wd = "(isodow(posting_date) - 1)"
    d, m = "day(posting_date)", "month(posting_date)"
    modes = "modes"

    def cyc(fn, part, period):
        return f"round(coalesce({fn}({two_pi} * {part} / {float(period)!r}), 0.0), 6)"

    return O.prepared_sql(f"""
, parts AS (SELECT {wd} AS weekday, {d} AS month_day, {m} AS month, quarter(posting_date) AS quarter
            FROM prepared WHERE posting_date IS NOT NULL),
{modes} AS (SELECT
  (SELECT weekday FROM parts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS weekday,
  (SELECT month_day FROM parts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS month_day,
  (SELECT month FROM parts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS month,
  (SELECT quarter FROM parts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS quarter)
SELECT txn_id,
 CAST(coalesce({wd}, (SELECT weekday FROM modes)) AS INTEGER) AS weekday,
 CAST(coalesce({d}, (SELECT month_day FROM modes)) AS INTEGER) AS month_day,
 CAST(coalesce({m}, (SELECT month FROM modes)) AS INTEGER) AS month,
 CAST(coalesce(quarter(posting_date), (SELECT quarter FROM modes)) AS INTEGER) AS quarter,
 {O.sql_flag(f'coalesce({d} >= 25, FALSE)')} AS is_month_end,
 {O.sql_flag(f'coalesce({d} <= 5, FALSE)')} AS is_month_start,
 {O.sql_flag(f'coalesce({wd} IN (5, 6), FALSE)')} AS is_weekend,
 {cyc('sin', d, 31)} AS day_cycle_sin, {cyc('cos', d, 31)} AS day_cycle_cos,
 {cyc('sin', m, 12)} AS month_cycle_sin, {cyc('cos', m, 12)} AS month_cycle_cos,
 {cyc('sin', wd, 7)} AS weekday_cycle_sin, {cyc('cos', wd, 7)} AS weekday_cycle_cos
FROM prepared""".replace("\n, parts", ", parts", 1))


@query("date_features", _date_feature_sql())
def q_date_features(spark, sf):
    df = prepared(spark, sf)
    out = feat.DateFeatures.fit(df).transform(df, keep=["txn_id"])
    return out.select("txn_id", *[F.col(c).cast("int").alias(c) for c in feat.CALENDAR_PARTS],
                      "is_month_end", "is_month_start", "is_weekend",
                      *[r6(F.col(c)).alias(c) for c in feat.DATE_FEATURES[7:]])


# --------------------------------------------------------- profile features
def _profile_family_query(name: str, families: list[str], source: str = "prepared"):
    p = profile()
    fam = O.profile_sql_columns(p)
    cols = ",\n ".join(f"{expr} AS {n}" for f in families for n, expr in fam[f])
    base = (f"SELECT txn_id, {cols} FROM (SELECT *, debit + credit AS amount FROM {source})")
    sql = O.prepared_sql(base) if source == "prepared" else O.ledger_sql(base)

    def run(spark, sf):
        df = prepared(spark, sf) if source == "prepared" else ledger_frame(spark, sf)
        dom = domain()
        fc = dom.family_columns()
        pre = dom.prepare(nz.with_amount(df))
        return pre.select("txn_id", *[c.alias(n) for f in families for n, c in fc[f]])

    run.__name__ = f"q_{name}"
    query(name, sql)(run)


_profile_family_query("entity_remarks", ["entity_remarks"])
_profile_family_query("entity_description", ["entity_description"])
_profile_family_query("text_signals", ["text_signal"])
_profile_family_query("amount_signals", ["amount"])
_profile_family_query("fiscal_indicators", ["fiscal"])
_profile_family_query("domain_features", ["entity_remarks", "text_signal", "entity_description",
                                          "amount", "fiscal", "structured", "vat"])


def _structured_subset(prefixes: tuple[str, ...]) -> tuple[list[tuple[str, str]], list[str]]:
    fam = O.profile_sql_columns(profile())["structured"]
    sel = [(n, e) for n, e in fam if n.startswith(prefixes)]
    return sel, [n for n, _ in sel]


_SEPA_SQL, _SEPA_NAMES = _structured_subset(("has_", "is_sepa"))
_MODE_SQL, _MODE_NAMES = _structured_subset(("txn_type_",))


@query("sepa_presence", O.prepared_sql(
    "SELECT txn_id, " + ", ".join(f"{e} AS {n}" for n, e in _SEPA_SQL) + " FROM prepared"))
def q_sepa_presence(spark, sf):
    dom = domain()
    fc = dict(p for p in dom.family_columns()["structured"])
    pre = dom.prepare(nz.with_amount(prepared(spark, sf)))
    return pre.select("txn_id", *[fc[n].alias(n) for n in _SEPA_NAMES])


@query("txn_mode", O.prepared_sql(
    f"SELECT txn_id, {O.sql_mode(profile())} AS txn_mode, "
    + ", ".join(f"{e} AS {n}" for n, e in _MODE_SQL) + " FROM prepared"))
def q_txn_mode(spark, sf):
    dom = domain()
    pre = dom.prepare(nz.with_amount(prepared(spark, sf)))
    fc = dict(p for p in dom.family_columns()["structured"])
    return pre.select("txn_id", F.col(dom._MODE).alias("txn_mode"), *[fc[n].alias(n) for n in _MODE_NAMES])


@query("domestic_iban", O.prepared_sql(
    "SELECT txn_id, " + ", ".join(f"{e} AS {n}" for n, e in O.profile_sql_columns(profile())[
        "structured"] if n in profile().derived) + " FROM prepared"))
def q_domestic_iban(spark, sf):
    dom = domain()
    fc = dict(p for p in dom.family_columns()["structured"])
    pre = dom.prepare(nz.with_amount(prepared(spark, sf)))
    return pre.select("txn_id", *[fc[n].alias(n) for n in profile().derived])


def _sepa_fields_sql() -> str:
    p = profile()
    c = O.sql_clean_extract("remarks")
    parts = [f"SELECT txn_id, '{n}' AS field, regexp_extract({c}, '{O._q(pat)}', 1, 'i') AS value "
             f"FROM prepared WHERE regexp_matches({c}, '{O._q(pat)}', 'i')"
             for n, pat in p.fields.items()]
    return O.prepared_sql("\nUNION ALL\n".join(parts))


@query("sepa_fields", _sepa_fields_sql())
def q_sepa_fields(spark, sf):
    dom = domain()
    pre = dom.prepare(nz.with_amount(prepared(spark, sf)))
    fields = pre.select("txn_id", dom.field_map().alias("fields"))
    # explode_outer: for explode the optimiser infers a filter on the map and pushes it below the projections that
    # build it, where it computes them once more
    return fields.select("txn_id", F.explode_outer("fields").alias("field", "value")).filter(F.col("field").isNotNull())


@query("vat_signals", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"{e} AS {n}" for n, e in O.profile_sql_columns(profile(), amount="l_extendedprice")["vat"])
       + " FROM lineitem")
def q_vat_signals(spark, sf):
    li = read_tables(spark, sf, "lineitem")["lineitem"]
    dom = domain()
    pre = dom.prepare(li.select("l_orderkey", "l_linenumber", "l_extendedprice",
                                F.lit("").alias("remarks"), F.lit("").alias("description"),
                                F.col("l_shipdate").alias("posting_date")),
                      amount="l_extendedprice")
    return pre.select("l_orderkey", "l_linenumber",
                      *[c.alias(n) for n, c in dom.family_columns()["vat"]])


def _coverage_sql() -> str:
    fam = O.profile_sql_columns(profile())
    rows = []
    for f, cols in fam.items():
        for n, e in cols:
            rows.append(f"SELECT '{n}' AS feature, '{f}' AS family, CAST(sum({e}) AS BIGINT) AS hits "
                        f"FROM (SELECT *, debit + credit AS amount FROM prepared)")
    return O.prepared_sql("\nUNION ALL\n".join(rows))


@query("feature_coverage", _coverage_sql())
def q_feature_coverage(spark, sf):
    dom = domain()
    fc = dom.family_columns()
    pre = dom.prepare(nz.with_amount(prepared(spark, sf)))
    pairs = [(f, n, c) for f, cols in fc.items() for n, c in cols]
    sums = pre.agg(*[F.sum(c).cast("bigint").alias(n) for _, n, c in pairs])
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(f).alias("family"),
                                         F.col(n).alias("hits")) for f, n, _ in pairs]))
    return sums.select(stack.alias("s")).select("s.*")


# ============================================================ scalar text
@query("strip_html", f"SELECT page_id, {O.sql_strip_html('html')} AS text FROM pages")
def q_strip_html(spark, sf):
    pages = read_tables(spark, sf, "pages")["pages"]
    return pages.select("page_id", tx.strip_html("html").alias("text"))


@query("strip_html_remarks", O.prepared_sql(
    f"SELECT txn_id, {O.sql_strip_html('remarks')} AS text FROM prepared"))
def q_strip_html_remarks(spark, sf):
    return prepared(spark, sf).select("txn_id", tx.strip_html("remarks").alias("text"))


@query("normalize_text", f"SELECT doc_id, {O.sql_normalize('text')} AS text FROM documents")
def q_normalize_text(spark, sf):
    docs = read_tables(spark, sf, "documents")["documents"]
    return docs.select("doc_id", tx.normalize_text("text").alias("text"))


@query("normalize_text_ascii",
       f"SELECT doc_id, {O.sql_normalize('text', False)} AS text FROM documents")
def q_normalize_text_ascii(spark, sf):
    docs = read_tables(spark, sf, "documents")["documents"]
    return docs.select("doc_id", tx.normalize_text("text", preserve_accents=False).alias("text"))


@query("clean_for_extraction", O.prepared_sql(
    f"SELECT txn_id, {O.sql_clean_extract('remarks')} AS text FROM prepared"))
def q_clean_for_extraction(spark, sf):
    return prepared(spark, sf).select("txn_id", tx.clean_for_extraction("remarks").alias("text"))


@query("strip_accents",
       f"SELECT doc_id, {O.sql_strip_accents(O.sql_normalize('text'))} AS text FROM documents")
def q_strip_accents(spark, sf):
    docs = read_tables(spark, sf, "documents")["documents"]
    return docs.select("doc_id", tx.strip_accents(tx.normalize_text("text")).alias("text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog_learn, catalog_more  # noqa: F401  (register the remaining queries)
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog_learn, catalog_more  # noqa: F401
    return dict(ORACLE)
