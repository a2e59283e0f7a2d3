"""Explanations as array expressions.

For a linear class score ``s_c(x) = sum_j W[c][j] * x_j`` the exact additive
attribution of feature j toward class c is ``W[c][j] * (x_j - mean_j)`` (the
contributions sum to ``s_c(x) - s_c(mean)``).  Coefficients and feature means
are bounded by classes x features and travel as literal arrays; per-row work
is higher-order array functions (no UDF, no shuffle); global importance is one
aggregate keyed by feature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N_CLASSES = 10
N_FEATURES = 64
TOP_N = 5
GLOBAL_TOP = 20


def rule_weights(n_classes: int = N_CLASSES, n_features: int = N_FEATURES) -> list[list[float]]:
    """Deterministic demonstration coefficients W[c][j] in [-1, 1]."""
    return [[((c * 7 + j * 3) % 11 - 5) / 5.0 for j in range(n_features)] for c in range(n_classes)]


def _lit_matrix(w: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in w])


def _lit_vector(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def feature_means(df: DataFrame, col: str = "x", n_features: int = N_FEATURES) -> list[float]:
    """Column means of an ARRAY<DOUBLE> feature column (one aggregate, n_features values)."""
    row = df.agg(*[F.avg(F.element_at(col, j + 1)).alias(f"m{j}") for j in range(n_features)]).first()
    return [float(row[f"m{j}"]) for j in range(n_features)]


def scores(x: Column, w: Column) -> Column:
    """Linear class scores: one dot product per coefficient row."""
    return F.transform(w, lambda row: F.aggregate(
        F.zip_with(row, x, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v))


def contributions(x: Column, w: Column, means: Column, cls: Column,
                  n_features: int = N_FEATURES) -> Column:
    """ARRAY<STRUCT<j, value, contribution>> toward class ``cls`` (0-based).

    The coefficient row, the features and the means are zipped once per row."""
    row = F.element_at(w, cls + 1)
    z = F.arrays_zip(row.alias("w"), x.alias("x"), means.alias("m"))
    return F.transform(z, lambda s, j: F.struct(
        j.alias("j"), s["x"].alias("value"), (s["w"] * (s["x"] - s["m"])).alias("contribution")))


def top_contributions(contribs: Column, n: int = TOP_N) -> Column:
    """The n largest contributions by magnitude (feature index breaks ties)."""
    keyed = F.transform(contribs, lambda s: F.struct(
        (-F.abs(s["contribution"])).alias("neg_abs"), s["j"].alias("j"), s["value"].alias("value"),
        s["contribution"].alias("contribution")))
    return F.slice(F.sort_array(keyed), 1, n)


def explain_linear(df: DataFrame, x_col: str, weights: list[list[float]],
                   means: list[float] | None = None, target_class: int | None = None,
                   n: int = TOP_N) -> DataFrame:
    """Per row predicted (or chosen) class and its top-n contributions."""
    n_classes = len(weights)
    if target_class is not None and not 0 <= target_class < n_classes:
        raise ValueError(f"Unknown target class: {target_class}")
    means = means if means is not None else feature_means(df, x_col, len(weights[0]))
    w, m = _lit_matrix(weights), _lit_vector(means)
    x = F.col(x_col)
    s = scores(x, w)
    cls = (F.lit(target_class) if target_class is not None
           else (F.array_position(s, F.array_max(s)) - 1).cast("int"))
    return df.withColumn("__cls", cls).withColumn(
        "top", top_contributions(contributions(x, w, m, F.col("__cls"), len(weights[0])), n))


def explain_fitted(model, df: DataFrame, keep: list[str], target_class: str | None = None,
                   n: int = TOP_N) -> DataFrame:
    """X1-X3 for a fitted ``LedgerModel``: ``keep``, ``code`` (the predicted class, or the chosen one),
    ``confidence``, ``margin`` = score less expected score, ``total`` = sum of all contributions (equal to it), and
    ``top``, the ``n`` largest contributions with feature names and values.

    Tree models: exact path attribution (``attribution.explain_trees``).  Linear ones: score(x) - score(mean) in
    parts; coefficients (classes x features) and means are sent once per task, a batch is a few matrix products."""
    if model.kind != "logistic":
        from .attribution import explain_trees
        return explain_trees(model, df, keep, target_class, n)
    coef, means, names, classes = _linear_parts(model)
    if target_class is not None and target_class not in classes:
        raise ValueError(f"this model has no class {target_class!r}")
    x = model.features.transform(df, keep=keep)
    intercept = model.classifier.interceptVector.toArray()
    shared = df.sparkSession.sparkContext.broadcast((coef, means, intercept, names))
    chosen = None if target_class is None else classes.index(target_class)
    top = "array<struct<feature:string,value:double,contribution:double>>"
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields if f.name in keep]

    def run(batches):
        w, m, b, label = shared.value
        label = pa.array(label, pa.string())
        for batch in batches:
            vec = batch["features"]
            idx, val = vec.field("indices"), vec.field("values")
            at = idx.offsets.to_numpy()
            col, num = idx.values.to_numpy(), val.values.to_numpy()
            for lo in range(0, batch.num_rows, 256):
                hi = min(batch.num_rows, lo + 256)
                dense = np.zeros((hi - lo, len(m)))
                row = np.repeat(np.arange(hi - lo), np.diff(at[lo:hi + 1]))
                dense[row, col[at[lo]:at[hi]]] = num[at[lo]:at[hi]]
                scores = dense @ w.T + b
                prob = np.exp(scores - scores.max(1, keepdims=True))
                prob /= prob.sum(1, keepdims=True)
                c = scores.argmax(1) if chosen is None else np.full(hi - lo, chosen)
                contribution = w[c] * (dense - m)
                r = np.arange(hi - lo)
                best = np.argsort(-np.abs(contribution), axis=1, kind="stable")[:, :n]
                flat, at_row = best.ravel(), np.repeat(r, best.shape[1])
                tops = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(r) + 1, dtype="int32") * best.shape[1]),
                    pa.StructArray.from_arrays(
                        [label.take(pa.array(flat)), pa.array(dense[at_row, flat]), pa.array(contribution[at_row, flat])],
                        names=["feature", "value", "contribution"]))
                yield pa.RecordBatch.from_arrays(
                    [*[batch[k].slice(lo, hi - lo) for k in keep], pa.array([classes[i] for i in c], pa.string()), pa.array(prob[r, c]),
                     pa.array(scores[r, c] - (w[c] @ m + b[c])), pa.array(contribution.sum(1)), tops],
                    names=[*keep, "code", "confidence", "margin", "total", "top"])
    return x.mapInArrow(run, ", ".join([*kept, "code string, confidence double, margin double, total double", f"top {top}"]))


def fitted_importance(model, df: DataFrame, top: int = GLOBAL_TOP) -> DataFrame:
    """X4 for a fitted model, largest first.  Linear: mean |contribution| over rows and classes; trees: over rows,
    toward the predicted class."""
    if model.kind != "logistic":
        from .attribution import tree_importance
        return tree_importance(model, df, top)
    coef, means, names, _ = _linear_parts(model)
    shared = df.sparkSession.sparkContext.broadcast(means)
    weight = np.abs(coef).mean(0)

    def spread(batches):
        # deviations |x - mean|: the part of the zeros is |mean| per row, corrected where x is not zero
        n, moved = 0, np.zeros(len(shared.value))
        for batch in batches:
            vec = batch["features"]
            col = vec.field("indices").flatten().to_numpy(zero_copy_only=False)
            num = vec.field("values").flatten().to_numpy(zero_copy_only=False)
            m = shared.value[col]
            moved += np.bincount(col, np.abs(num - m) - np.abs(m), len(moved))
            n += batch.num_rows
        at = np.flatnonzero(moved)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype("int32")), pa.array(np.append(moved[at], n))],
                                         names=["j", "v"])
    x = model.features.transform(df, keep=[])
    sums = {r["j"]: r["v"] for r in x.mapInArrow(spread, "j int, v double").groupBy("j").agg(F.sum("v").alias("v")).collect()}
    n = max(sums.pop(-1, 0.0), 1.0)
    rows = [(names[j], float(weight[j] * (abs(means[j]) + sums.get(j, 0.0) / n))) for j in range(len(names))]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double") \
             .orderBy(F.desc("importance"), "feature").limit(top)


def _linear_parts(model):
    if model.kind != "logistic" or model.means is None:
        raise ValueError("exact contributions need a linear model (kind 'logistic')")
    return model.classifier.coefficientMatrix.toArray(), model.means, model.features.feature_names(), model.classes


def embedding_features(e: DataFrame) -> DataFrame:
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def top_contributions_query(e: DataFrame) -> DataFrame:
    feats = embedding_features(e)
    out = explain_linear(feats, "x", rule_weights())
    ex = out.select("vec_id", F.col("__cls").alias("predicted"),
                    F.posexplode("top").alias("pos", "t"))
    return ex.select("vec_id", "predicted", (F.col("pos") + 1).cast("int").alias("rank"),
                     F.concat(F.lit("f_"), F.col("t.j").cast("string")).alias("feature"),
                     F.round("t.value", 4).alias("value"),
                     F.round("t.contribution", 4).alias("contribution"))


def global_importance(df: DataFrame, x_col: str, weights: list[list[float]],
                      top: int = GLOBAL_TOP) -> DataFrame:
    """Mean |contribution| over rows and classes per feature, top features.

    mean_{rows,c} |W[c][j] (x_j - m_j)| = mean_rows |x_j - m_j| * mean_c |W[c][j]|,
    so one aggregate keyed by feature suffices."""
    n_features = len(weights[0])
    means = feature_means(df, x_col, n_features)
    wabs = [sum(abs(weights[c][j]) for c in range(len(weights))) / len(weights)
            for j in range(n_features)]
    m = _lit_vector(means)
    dev = df.select(F.posexplode(F.col(x_col)).alias("j", "v")) \
            .select("j", F.abs(F.col("v") - F.element_at(m, F.col("j") + 1)).alias("d"))
    per = dev.groupBy("j").agg(F.avg("d").alias("mad"))
    imp = per.select("j", (F.col("mad") * F.element_at(_lit_vector(wabs), F.col("j") + 1))
                     .alias("importance"))
    return imp.orderBy(F.desc("importance"), "j").limit(top)


def global_importance_query(e: DataFrame) -> DataFrame:
    out = global_importance(embedding_features(e), "x", rule_weights())
    return out.select(F.concat(F.lit("f_"), F.col("j").cast("string")).alias("feature"),
                      F.round("importance", 6).alias("importance"))


# ------------------------------------------------------------- SQL oracle
def _sql_matrix(w: list[list[float]]) -> str:
    return "[" + ", ".join("[" + ", ".join(repr(float(v)) for v in row) + "]" for row in w) + "]"


_EMB_X = """
WITH emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT unnest(generate_series(0, len(x) - 1)) AS j, unnest(x) AS v FROM emb),
means AS (SELECT list(m ORDER BY j) AS m FROM (SELECT j, avg(v) AS m FROM u GROUP BY j))"""


def top_contributions_sql() -> str:
    w = _sql_matrix(rule_weights())
    return _EMB_X + f""",
sc AS (SELECT vec_id, x, list_transform({w}, lambda row: list_sum(list_transform(
          generate_series(1, len(row)), lambda k: row[k] * x[k])))  AS s FROM emb),
pc AS (SELECT vec_id, x, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS predicted FROM sc),
c AS (SELECT vec_id, predicted, unnest(generate_series(0, {N_FEATURES - 1})) AS j FROM pc),
cv AS (SELECT c.vec_id, c.predicted, c.j, pc.x[c.j + 1] AS value,
              ({w})[c.predicted + 1][c.j + 1] * (pc.x[c.j + 1] - (SELECT m FROM means)[c.j + 1])
              AS contribution
       FROM c JOIN pc USING (vec_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(contribution) DESC, j) AS rank
      FROM cv)
SELECT vec_id, predicted, CAST(rank AS INTEGER) AS rank, 'f_' || CAST(j AS VARCHAR) AS feature,
       round(value, 4) AS value, round(contribution, 4) AS contribution FROM r WHERE rank <= {TOP_N}"""


def global_importance_sql() -> str:
    weights = rule_weights()
    wabs = [sum(abs(weights[c][j]) for c in range(len(weights))) / len(weights)
            for j in range(len(weights[0]))]
    wlist = "[" + ", ".join(repr(v) for v in wabs) + "]"
    return _EMB_X + f""",
per AS (SELECT j, avg(abs(v - (SELECT m FROM means)[j + 1])) AS mad FROM u GROUP BY j),
imp AS (SELECT j, mad * ({wlist})[j + 1] AS importance FROM per)
SELECT 'f_' || CAST(j AS VARCHAR) AS feature, round(importance, 6) AS importance FROM imp
ORDER BY importance DESC, j LIMIT {GLOBAL_TOP}"""
