"""Evaluation and monitoring as DataFrame aggregates.

Inputs are prediction frames: ``y_true`` and ``y_pred`` (class index or code)
and, for ranking metrics, ``proba`` ARRAY<DOUBLE>.  Per-row work (ranking,
arg-max, bin assignment) is array / CASE expressions; everything else is a
partial aggregate keyed by class or bin, whose output is bounded by the
number of classes or bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.split import LEAF_ROWS

TOPK_VALUES = (1, 3, 5, 10)


# ----------------------------------------------------------------- per row
def _with_scalar(arr: Column, value: Column, name: str = "c") -> Column:
    """Pair each element with a per-row scalar, evaluated once (not per element)."""
    return F.arrays_zip(arr.alias("x"), F.array_repeat(value, F.size(arr)).alias(name))


def softmax(arr: Column) -> Column:
    """Numerically stable softmax of an ARRAY<DOUBLE> (linear in the array size)."""
    ex = F.transform(_with_scalar(arr, F.array_max(arr)), lambda s: F.exp(s["x"] - s["c"]))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(_with_scalar(ex, total), lambda s: s["x"] / s["c"])


def argmax(arr: Column) -> Column:
    """K3: 0-based index of the first maximum."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def top_k(arr: Column, k: int) -> Column:
    """K2: ARRAY<STRUCT<idx INT, p DOUBLE>> of the k best classes
    (probability descending, class index ascending on ties).  No shuffle."""
    indexed = F.transform(arr, lambda x, i: F.struct((-x).alias("neg"), i.cast("int").alias("idx")))
    best = F.slice(F.sort_array(indexed), 1, k)
    ranked = F.transform(best, lambda s: F.struct(s["idx"].alias("idx"), (-s["neg"]).alias("p")))

    def found(s: Column) -> Column:
        """By place of the k largest values, which says as much if these are numbers above 0 that differ."""
        top = [F.get(s, F.size(s) - 1 - i) for i in range(k)]
        clear = F.get(s, F.lit(0)).isNotNull() & (top[k - 1] > 0) & ~F.isnan(top[0].cast("double"))
        for x, y in zip(top, top[1:]):
            clear = clear & (x > y)
        places = F.array(*[F.struct((F.array_position(arr, x) - 1).cast("int").alias("idx"), x.alias("p")) for x in top])
        return F.when(clear, places).otherwise(ranked)
    # bound to a variable, so that the values are sorted once; a lambda per value costs more than sorting them
    return F.element_at(F.transform(F.array(F.sort_array(arr)), found), 1) if k > 0 else ranked


def true_rank(arr: Column, y_true: Column) -> Column:
    """1 + number of classes scored strictly higher than the true class."""
    t = F.element_at(arr, y_true + 1)
    higher = F.transform(_with_scalar(arr, t), lambda s: (s["x"] > s["c"]).cast("int"))
    return (F.aggregate(higher, F.lit(0), lambda acc, x: acc + x) + 1).cast("int")


# ------------------------------------------------------------ class metrics
def confusion_pairs(pred: DataFrame, t: str = "y_true", p: str = "y_pred") -> DataFrame:
    """(y_true, y_pred, n)."""
    return pred.groupBy(F.col(t).alias("y_true"), F.col(p).alias("y_pred")) \
               .agg(F.count(F.lit(1)).alias("n"))


def per_class(pred: DataFrame, t: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Per class over the union of true and predicted labels: support,
    predicted count, true positives, precision, recall, F1 (0 on zero division)."""
    pairs = confusion_pairs(pred, t, p)
    true_side = pairs.groupBy(F.col("y_true").alias("cls")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp"))
    pred_side = pairs.groupBy(F.col("y_pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    cls = true_side.join(pred_side, "cls", "full_outer").select(
        "cls", F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("predicted", F.lit(0)).alias("predicted"),
        F.coalesce("tp", F.lit(0)).alias("tp"))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    cls = cls.withColumn("precision", prec.cast("double")).withColumn("recall", rec.cast("double"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(0.0)
    return cls.withColumn("f1", f1)


def classification_report(pred: DataFrame, t: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Accuracy, balanced accuracy and macro / weighted precision, recall, F1."""
    c = per_class(pred, t, p)
    n = F.sum("support")
    wavg = lambda m: F.sum(F.col(m) * F.col("support")) / n
    return c.agg(
        (F.sum("tp") / n).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("f1_macro"), wavg("f1").alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"), wavg("precision").alias("precision_weighted"),
        F.avg("recall").alias("recall_macro"), wavg("recall").alias("recall_weighted"),
    )


def class_distribution(labels: DataFrame, col: str = "y_true") -> DataFrame:
    """Classes ranked by frequency (count desc, class asc)."""
    counts = labels.groupBy(F.col(col).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("n"), F.asc("cls"))  # one row per class: bounded
    return counts.select(F.row_number().over(w).alias("class_rank"), "cls", "n")


def top_classes(labels: DataFrame, n: int, col: str = "y_true") -> DataFrame:
    """The n most frequent classes (TakeOrderedAndProject, bounded by n)."""
    return (labels.groupBy(F.col(col).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("cls")).limit(n))


def per_class_performance(pred: DataFrame, top_n: int = 20) -> DataFrame:
    """Precision / recall of the top-N classes by support."""
    top = top_classes(pred, top_n).select("cls")
    return per_class(pred).join(F.broadcast(top), "cls").select("cls", "support", "precision",
                                                                 "recall")


def confusion_matrix(pred: DataFrame, top_n: int = 20, other: str = "Other") -> DataFrame:
    """Counts for the top-N true classes plus "Other", zero cells included.

    The (N+1)^2 grid is generated by exploding the label list twice inside one
    row (no join of two tables), then the counts are left-joined on it."""
    top = top_classes(pred, top_n).select(F.col("cls").cast("string").alias("cls"))
    labels = top.agg(F.array_append(F.collect_list("cls"), F.lit(other)).alias("labels"))
    grid = labels.select(F.explode("labels").alias("y_true"), "labels") \
                 .select("y_true", F.explode("labels").alias("y_pred"))
    keep = F.broadcast(top.withColumn("__k", F.lit(True)))
    mapped = (pred.select(F.col("y_true").cast("string").alias("t"),
                          F.col("y_pred").cast("string").alias("p"))
              .join(keep.withColumnRenamed("cls", "t"), "t", "left")
              .withColumn("t", F.when(F.col("__k"), F.col("t")).otherwise(F.lit(other))).drop("__k")
              .join(keep.withColumnRenamed("cls", "p"), "p", "left")
              .withColumn("p", F.when(F.col("__k"), F.col("p")).otherwise(F.lit(other))).drop("__k"))
    counts = mapped.groupBy(F.col("t").alias("y_true"), F.col("p").alias("y_pred")) \
                   .agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["y_true", "y_pred"], "left") \
               .select("y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# --------------------------------------------------------- ranking metrics
def topk_accuracy(pred: DataFrame, n_classes: int, ks=TOPK_VALUES) -> DataFrame:
    """Share of rows whose true class is among the k best (k <= classes)."""
    ks = [k for k in ks if k <= n_classes]
    r = pred.select(true_rank(F.col("proba"), F.col("y_true")).alias("r"))
    agg = r.agg(*[F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)).alias(f"k{k}") for k in ks])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias(
        "accuracy")) for k in ks])).alias("s")).select("s.*")


def _edges(n_bins: int) -> list[float]:
    """Np.linspace(0, 1, n+1) edges, i * (1/n) except the last = 1."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def bin_index(conf: Column, n_bins: int = 10, close_last: bool = True) -> Column:
    """Bin of a confidence on literal edges; the histogram closes its last bin,
    calibration does not (conf == 1.0 then falls in no bin → null)."""
    e = _edges(n_bins)
    expr = None
    for i in range(n_bins):
        hi_ok = (conf <= e[i + 1]) if (close_last and i == n_bins - 1) else (conf < e[i + 1])
        cond = (conf >= e[i]) & hi_ok
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def _bins_frame(pred: DataFrame, n_bins: int) -> DataFrame:
    spark = pred.sparkSession
    e = _edges(n_bins)
    return spark.createDataFrame([(i, e[i], e[i + 1]) for i in range(n_bins)],
                                 "bin int, lo double, hi double")


def calibration(pred: DataFrame, n_bins: int = 10) -> DataFrame:
    """Per confidence bin: accuracy, mean confidence, count; empty bin →
    0, bin midpoint, 0."""
    conf = F.array_max("proba")
    rows = pred.select(bin_index(conf, n_bins, close_last=False).alias("bin"), conf.alias("conf"),
                       (argmax(F.col("proba")) == F.col("y_true")).cast("double").alias("ok"))
    g = rows.filter(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.avg("ok").alias("acc"), F.avg("conf").alias("mc"), F.count(F.lit(1)).alias("n"))
    bins = F.broadcast(_bins_frame(pred, n_bins))   # n_bins rows
    return bins.join(g, "bin", "left").select(
        "bin", F.coalesce("acc", F.lit(0.0)).alias("accuracy"),
        F.coalesce("mc", (F.col("lo") + F.col("hi")) / 2).alias("mean_confidence"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confidence_histogram(conf: DataFrame, col: str = "confidence", n_bins: int = 10
                         ) -> DataFrame:
    """Counts per bin over [0, 1] (last bin closed)."""
    g = conf.select(bin_index(F.col(col), n_bins).alias("bin")).filter(F.col("bin").isNotNull()) \
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    bins = F.broadcast(_bins_frame(conf, n_bins))
    return bins.join(g, "bin", "left").select(
        "bin", F.round("lo", 2).alias("bin_lo"), F.round("hi", 2).alias("bin_hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# -------------------------------------------------------------- quantiles
def kth_value(df: DataFrame, col: str, k: int, n: int, lo: float, hi: float,
              leaf_rows: int = LEAF_ROWS, buckets: int = 1024) -> float:
    """Exact k-th smallest value (1-based) by distributed range refinement:
    bucket counts (partial aggregate) pick the bucket holding rank k, repeat
    on it until few candidates remain, then sort only those."""
    frame = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    refined = False
    while lo < hi and not (refined and n <= leaf_rows):
        refined = True
        width = (hi - lo) / buckets
        b = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(buckets - 1)).cast("int")
        counts = sorted((r["b"], r["c"]) for r in
                        frame.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect())
        before = 0
        for bi, c in counts:
            if before + c >= k:
                break
            before += c
        k -= before
        n = c
        new_lo = lo + bi * width
        new_hi = hi if bi == buckets - 1 else lo + (bi + 1) * width
        cond = (F.col("v") >= new_lo) & ((F.col("v") <= new_hi) if bi == buckets - 1
                                         else (F.col("v") < new_hi))
        frame = frame.filter(cond)
        st = frame.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
        lo, hi = float(st["lo"]), float(st["hi"])
    if lo == hi:
        return lo
    w = Window.orderBy("v")        # bounded: at most leaf_rows candidates
    return float(frame.select("v", F.row_number().over(w).alias("rn"))
                 .filter(F.col("rn") == k).first()["v"])


def exact_median(df: DataFrame, col: str) -> float | None:
    """Median with the midpoint of the two middle values for even counts."""
    st = df.agg(F.count(col).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    n = int(st["n"])
    if n == 0:
        return None
    lo, hi = float(st["lo"]), float(st["hi"])
    a = kth_value(df, col, (n + 1) // 2, n, lo, hi)
    if n % 2 == 1:
        return a
    b = kth_value(df, col, n // 2 + 1, n, lo, hi)
    return (a + b) / 2.0


def confidence_summary(conf: DataFrame, col: str = "confidence") -> DataFrame:
    """N, mean and exact median confidence (rounded to 4 places)."""
    med = exact_median(conf, col)
    return conf.agg(F.count(F.lit(1)).alias("n_samples"),
                    F.round(F.avg(col), 4).alias("mean_confidence")) \
               .withColumn("median_confidence",
                           F.round(F.lit(med).cast("double"), 4))


def confidence_drift(conf: DataFrame, ts: str = "ts", col: str = "confidence",
                     window: str = "1 day", n_bins: int = 10) -> DataFrame:
    """Per time window, the normalised confidence histogram and its L1
    distance to the previous window's histogram."""
    rows = conf.select(F.window(F.col(ts), window).start.alias("w"),
                       bin_index(F.col(col), n_bins).alias("bin"), F.col(col))
    per_w = rows.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("mean_conf"))
    per_wb = rows.groupBy("w", "bin").agg(F.count(F.lit(1)).alias("nb"))
    grid = per_w.select("w", "n", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    shares = grid.join(per_wb, ["w", "bin"], "left").select(
        "w", "bin", (F.coalesce("nb", F.lit(0)) / F.col("n")).alias("share"))
    prev = F.lag("share").over(Window.partitionBy("bin").orderBy("w"))
    dist = shares.select("w", F.abs(F.col("share") - prev).alias("d")) \
                 .groupBy("w").agg(F.sum("d").alias("l1_drift"))
    return per_w.join(dist, "w").select("w", "n", "mean_conf", "l1_drift")


# --------------------------------------------------------------------- gate
def quality_gate(metrics: DataFrame, baseline_accuracy: Column, n_classes: Column,
                 min_lift: float = 0.20) -> DataFrame:
    """Accuracy >= baseline*(1+lift) and balanced >= (1+lift)/classes;
    a missing metric counts as 0; equality passes."""
    acc = F.coalesce(F.col("accuracy"), F.lit(0.0))
    bal = F.coalesce(F.col("balanced_accuracy"), F.lit(0.0))
    acc_t = baseline_accuracy * F.lit(1.0 + min_lift)
    bal_t = (F.lit(1.0) / F.greatest(n_classes, F.lit(1))) * F.lit(1.0 + min_lift)
    return metrics.select(
        acc.alias("accuracy"), bal.alias("balanced_accuracy"),
        baseline_accuracy.alias("baseline_accuracy"), acc_t.alias("acc_threshold"),
        bal_t.alias("bal_threshold"),
        F.when((acc >= acc_t) & (bal >= bal_t), F.lit(1)).otherwise(F.lit(0)).alias("passed"))


def midpoint(i: int, n_bins: int = 10) -> float:
    e = _edges(n_bins)
    return (e[i] + e[i + 1]) / 2

