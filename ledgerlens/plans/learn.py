"""Feature assembly, training and scoring.

Fitting reads every training row: the label encoder is a ``StringIndexer`` (alphabetical,
like a sorted label encoder), the classifier a random forest on sparse rows by default
(``operators/forest.py``), Spark ML's multinomial logistic regression as the linear
option, or joint softmax boosting with early stopping.  Features per row:

* TF-IDF: words and texts from Column expressions; per Arrow batch their
  n-grams (numbers, ``functions/grams.py``) are looked up in the fitted vocabulary (bounded, shipped with the closure) and
  become sparse vectors: sublinear TF x smooth IDF, L2 per block.  No shuffle:
  every row is vectorised where it lives.
* Dense: 8 numeric + 13 calendar + the profile's domain block, assembled as
  one ARRAY<DOUBLE> (one column keeps the plan within codegen limits).

Scoring is a single narrow stage (no shuffle): features → probabilities →
ranked top-k codes.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import evaluate as ev
from ..operators import features as feat
from ..operators import normalize as nz
from ..operators.boosting import SoftmaxBoosting, SoftmaxModel
from ..operators.forest import ForestModel, RandomForest
from ..operators.profile import DomainFeatures
from ..operators.tfidf import LEDGER_BLOCKS, BlockSpec, TfidfModel, TfidfVectorizer, batch_weights, ledger_texts

FAMILIES = ("text", "numeric", "date", "domain")


# ------------------------------------------------------------ TF-IDF vector
def vector_batch(batch: pa.RecordBatch, tables: list, dense_width: int) -> pa.StructArray:
    """Sparse vectors of one batch: TF-IDF blocks first (sublinear TF x smooth IDF, L2 per block), the dense
    values after them.  Built from whole index and value arrays; no Python object per row."""
    parts, width = [], 0                               # (row, column, value), in order of row and column each
    for b, (terms, idf, _) in tables:
        row, code, weight = batch_weights(batch[f"__u_{b.name}"], b, terms, idf)
        parts.append((row, code + width, weight))
        width += len(terms)
    if dense_width:
        flat = batch["__dense"].flatten().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(flat)
        parts.append((at // dense_width, at % dense_width + width, flat[at]))
        width += dense_width
    n = batch.num_rows
    sizes = [np.bincount(row, minlength=n) for row, _, _ in parts]
    upto = np.append(0, np.cumsum(sum(sizes, np.zeros(n, "int64"))))
    col, val, next_free = np.empty(upto[-1], "int32"), np.empty(upto[-1]), upto[:-1].copy()
    for (row, c, v), size in zip(parts, sizes):        # blocks one after the other within a row: no sort
        at = np.arange(len(row)) + np.repeat(next_free - np.append(0, np.cumsum(size)[:-1]), size) if len(row) else row
        col[at], val[at] = c, v
        next_free += size
    offsets = pa.array(upto.astype("int32"))
    return pa.StructArray.from_arrays(
        [pa.array(np.zeros(n, "int8")), pa.array(np.full(n, width, "int32")),
         pa.ListArray.from_arrays(offsets, pa.array(col)), pa.ListArray.from_arrays(offsets, pa.array(val))], names=["type", "size", "indices", "values"])


@dataclass
class FeatureModel:
    """F1 fitted state: date fill modes and TF-IDF vocabularies."""

    date_features: feat.DateFeatures
    domain: DomainFeatures
    tfidf: TfidfModel | None
    families: tuple[str, ...] = FAMILIES
    seconds: float = 0.0                   # of the fit

    def only(self, families: tuple[str, ...]) -> "FeatureModel":
        """The same fit for some of its families."""
        return replace(self, families=tuple(families), tfidf=self.tfidf if "text" in families else None)

    def feature_names(self) -> list[str]:
        """names in vector order (text blocks first, then dense)."""
        names = []
        if self.tfidf is not None and "text" in self.families:
            rows = self.tfidf.feature_names().orderBy("col_index").collect()
            names += [r["name"] for r in rows]
        dense = self._dense_pairs_names()
        return names + dense

    def _dense_pairs_names(self) -> list[str]:
        out = []
        if "numeric" in self.families:
            out += list(feat.NUMERIC_FEATURES)
        if "date" in self.families:
            out += list(feat.DATE_FEATURES)
        if "domain" in self.families:
            out += self.domain.feature_names
        return out

    def dense_pairs(self) -> list[tuple[str, Column]]:
        """(name, Column) of the dense families, reading ``DomainFeatures.prepare`` output."""
        pairs: list[tuple[str, Column]] = []
        if "numeric" in self.families:
            pairs += list(zip(feat.NUMERIC_FEATURES, feat.numeric_feature_columns()))
        if "date" in self.families:
            pairs += list(zip(feat.DATE_FEATURES, self.date_features.columns()))
        if "domain" in self.families:
            for fam in self.domain.family_columns().values():
                pairs += fam
        return pairs

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Rows of ``df`` (``keep`` columns) plus ``features`` (sparse TF-IDF ⊕ dense).

        Narrow projections only: no shuffle."""
        keep = keep if keep is not None else df.columns
        cols = [F.col(c) for c in keep]
        pre = self.domain.prepare(nz.with_amount(df))
        pairs = self.dense_pairs()
        # filled in a lambda: that keeps the projection out of whole-stage code, whose one method for all rules would be
        # too long for the JVM's compiler (8,000 bytes)
        dense = F.transform(F.array(*[c.cast("double") for _, c in pairs]), lambda x: F.coalesce(x, F.lit(0.0)))
        use_text = self.tfidf is not None and "text" in self.families
        blocks = self.tfidf.blocks if use_text else ()
        staged = pre.select(*cols, dense.alias("__dense"), txt_desc().alias("__t_desc"),
                            txt_rem().alias("__t_rem")) if use_text else \
            pre.select(*cols, dense.alias("__dense"))
        if use_text:
            staged = staged.withColumn("__t_chr", F.concat(F.col("__t_desc"), F.lit(" "),
                                                           F.col("__t_rem")))
        units = staged.select(*cols, "__dense", *[
            b.tokens(F.col(f"__t_{b.name}")).alias(f"__u_{b.name}") for b in blocks])
        found = self.tfidf.lookup_tables() if use_text else {}
        tables = [(b, found[b.name]) for b in blocks]
        n_dense = len(pairs)

        def vectorise(batches):
            # words and texts arrive as plain columns of each Arrow batch; rows never move
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], vector_batch(batch, tables, n_dense)],
                                                 names=[*keep, "features"])

        schema = T.StructType([units.schema[c] for c in keep]
                              + [T.StructField("features", VectorUDT(), False)])
        return units.mapInArrow(vectorise, schema)


def txt_desc() -> Column:
    from ..functions import text as tx
    return tx.normalize_text(F.col("description"))


def txt_rem() -> Column:
    from ..functions import text as tx
    return tx.normalize_html("remarks")


def fit_features(train: DataFrame, families: tuple[str, ...] = FAMILIES,
                 domain: DomainFeatures | None = None,
                 blocks: tuple[BlockSpec, ...] = LEDGER_BLOCKS,
                 tfidf: Callable[[], TfidfModel] | None = None) -> FeatureModel:
    """F1 fit: date modes (A6) and vocabularies (T5) from training rows only; ``tfidf`` gives vocabularies that are
    fitted on them already or fitted elsewhere."""
    t0 = time.time()
    domain = domain or DomainFeatures()
    dates = feat.DateFeatures.fit(train)
    tfm = None
    if "text" in families:
        tfm = tfidf() if tfidf else TfidfVectorizer(blocks).fit(ledger_texts(train))
    return FeatureModel(dates, domain, tfm, families, time.time() - t0)


# ------------------------------------------------------------ classifier
def make_classifier(kind: str = "forest", **params):
    """A probabilistic multi-class classifier."""
    if kind == "forest":
        defaults = dict(numTrees=40, maxDepth=10, maxBins=32, subsamplingRate=0.7,
                        featureSubsetStrategy="sqrt", minInstancesPerNode=1, seed=42)
        defaults.update(params)
        return RandomForest(**defaults)
    if kind == "logistic":
        defaults = dict(maxIter=100, regParam=0.001, elasticNetParam=0.0, tol=1e-6, family="multinomial")
        defaults.update(params)
        return LogisticRegression(featuresCol="features", labelCol="label", **defaults)
    if kind == "boosted":
        return SoftmaxBoosting(**params)
    raise ValueError(f"unknown classifier kind: {kind}")


@dataclass
class LedgerModel:
    """A fitted bundle: features, label encoder, classifier, metrics."""

    features: FeatureModel
    labels: StringIndexerModel
    classifier: Model | ForestModel | SoftmaxModel
    train_seconds: float = 0.0
    metrics: dict = field(default_factory=dict)
    baseline_accuracy: float = 0.0
    kind: str = "forest"
    means: np.ndarray | None = None        # of the feature columns over the fitted rows

    @property
    def classes(self) -> list[str]:
        return list(self.labels.labels)

    def score(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """L4: rows plus ``proba`` ARRAY<DOUBLE> and ``y_pred`` (class index)."""
        keep = keep if keep is not None else ["txn_id"]
        x = self.features.transform(df, keep=keep)
        out = self.classifier.transform(x)
        proba = vector_to_array("probability")
        return out.select(*keep, proba.alias("proba")).withColumn("y_pred", ev.argmax(F.col("proba")))

    def classify(self, df: DataFrame, k: int = 3, keep: list[str] | None = None) -> DataFrame:
        """Ranked top-k codes with confidence rounded to 4 places."""
        keep = keep if keep is not None else ["txn_id"]
        scored = self.score(df, keep)
        codes = F.array(*[F.lit(c) for c in self.classes])
        best = ev.top_k(F.col("proba"), k)
        ranked = F.transform(best, lambda s: F.struct(
            F.element_at(codes, s["idx"] + 1).alias("code"),
            F.round(s["p"], 4).alias("confidence")))
        return scored.select(*keep, ranked.alias("predictions"))

    def predictions(self, val: DataFrame) -> DataFrame:
        """(txn_id, y_true, y_pred, proba) of the rows with known classes: the input of every evaluation."""
        enc = self.labels.transform(val.filter(F.col("target").isin(self.classes)))
        return self.score(enc, keep=["txn_id", "label"]).select(
            "txn_id", F.col("label").cast("int").alias("y_true"), "y_pred", "proba")

    def evaluate(self, val: DataFrame) -> DataFrame:
        """E1 on validation rows with known classes (P10)."""
        return ev.classification_report(self.predictions(val))


def fit_labels(train: DataFrame) -> StringIndexerModel:
    """L1: sorted classes → 0-based index."""
    return StringIndexer(inputCol="target", outputCol="label", stringOrderType="alphabetAsc",
                         handleInvalid="skip").fit(train)


def train(train_df: DataFrame, kind: str = "forest", families: tuple[str, ...] = FAMILIES,
          domain: DomainFeatures | None = None, features: FeatureModel | None = None,
          **params) -> LedgerModel:
    """L3 core: guards (P3, P8), then features, labels and the classifier, each from all training rows.

    The assembled rows are persisted while they are read again and again, and so is the training ledger, unless
    ``features`` fitted on its rows are given: what is left then is a few narrow reads.  Their seconds count as
    this model's too."""
    t0 = time.time()
    if features is None:
        train_df = train_df.persist()
    try:
        n_rows = nz.validate_ledger(train_df)
        fm = fit_features(train_df, families, domain) if features is None else features.only(families)
        labels = fit_labels(train_df)
        largest = train_df.groupBy("target").count().agg(F.max("count")).first()[0]
        x = labels.transform(fm.transform(train_df, keep=["txn_id", "target"])).persist()
        try:
            clf = make_classifier(kind, **params).fit(x)
            means = x.select(Summarizer.mean(F.col("features"))).first()[0].toArray()
        finally:
            x.unpersist()
    finally:
        if features is None:
            train_df.unpersist()
    seconds = time.time() - t0 + (0.0 if features is None else features.seconds)
    return LedgerModel(fm, labels, clf, seconds, baseline_accuracy=largest / n_rows, kind=kind, means=means)


def gate(metrics: dict, baseline_accuracy: float, n_classes: int, min_lift: float = 0.20) -> dict:
    """L11 on a metrics dict (driver-side twin of ``evaluate.quality_gate``)."""
    acc = float(metrics.get("accuracy", 0.0) or 0.0)
    bal = float(metrics.get("balanced_accuracy", 0.0) or 0.0)
    acc_t = baseline_accuracy * (1 + min_lift)
    bal_t = (1.0 / max(n_classes, 1)) * (1 + min_lift)
    return {"passed": acc >= acc_t and bal >= bal_t, "accuracy": acc, "balanced_accuracy": bal,
            "acc_threshold": acc_t, "bal_threshold": bal_t,
            "baseline_accuracy": baseline_accuracy, "min_lift": min_lift}
