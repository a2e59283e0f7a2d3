"""Structured Streaming scoring and monitoring (Z1-Z3, E9 on a stream).

Streams read a Parquet folder (``readStream``), apply the same Column
transformations as the batch queries, and aggregate per event-time window.
Only fitted artefacts (vocabularies, date modes, label list, classifier) are
used on a stream: nothing is re-fitted per micro-batch.

* ``StreamTable``: append mode into Parquet; a window is written once, when the
  watermark has passed it, and its state is dropped.
* ``WindowTable``: an upsert sink for window counts.  Every micro-batch writes
  the new totals of the windows it touches as a version; however late an event
  is, it corrects its window, and a replayed batch changes nothing.
* ``drift_stream``: distance between the confidence histograms of consecutive
  windows, kept as state and given out as windows close.

``feed`` hands a batch frame to a stream in steps.  Tables and checkpoints lie
under the shared ``spark.checkpoint.dir``; production jobs pass their own
trigger.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..session import scratch_path

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, " \
               "value double, props string"


def stage_folder(spark: SparkSession, df: DataFrame, name: str, files: int | None = None) -> str:
    """Write a batch frame as a Parquet folder a file stream can read, in its natural partitions or in ``files``."""
    path = scratch_path(spark, f"stream-src-{name}-{uuid.uuid4().hex[:8]}")
    (df.repartition(files) if files else df).write.parquet(path)
    return path


def feed(df: DataFrame, name: str, by: str, steps: int = 4, closing: bool = False):
    """Yield a folder after each of ``steps`` appends of ``df`` to it, in order of ``by`` (a number or a time); rows
    without a value come with the first.  A step keeps the partitions of ``df``: nothing passes through one task.

    With ``closing`` the last step also brings a row far enough behind the last event that a watermark of a day passes
    every window of a day that holds an event; the row's own window stays open, so it is never written."""
    spark = df.sparkSession
    path = scratch_path(spark, f"stream-src-{name}-{uuid.uuid4().hex[:8]}")
    at = F.col(by).cast("timestamp") if "timestamp" in df.schema[by].dataType.simpleString() else F.col(by)
    order = at.cast("double")
    cuts = df.select(F.percentile_approx(order, [i / steps for i in range(1, steps)])).first()[0] or []
    edges = [None, *cuts, None]
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
        step = df if low is None else df.filter(order > low)
        if high is not None:
            step = step.filter((order <= high) | order.isNull()) if low is None else step.filter(order <= high)
        step.write.mode("append").parquet(path)
        if closing and i + 2 == len(edges):
            closing_row(df, by).coalesce(1).write.mode("append").parquet(path)
        yield path


def closing_row(df: DataFrame, by: str, far: str = "interval 3 days") -> DataFrame:
    """One row of ``df``'s columns, null but for its time: the last one plus ``far``.  None for a frame without times."""
    kind = df.schema[by].dataType
    last = df.agg(F.max(by).alias(by)).filter(F.col(by).isNotNull()).select((F.col(by) + F.expr(far)).cast(kind).alias(by))
    return last.select(*[F.col(by) if f.name == by else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])


def event_stream(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def confidence_windows(events: DataFrame, window: str = "1 day", watermark: str = "1 day",
                       n_bins: int = 10) -> DataFrame:
    """Per tumbling window and confidence bin, the number of events."""
    conf = F.least(F.col("value") / 500.0, F.lit(1.0))
    return (events.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w"), ev.bin_index(conf, n_bins).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def class_counts_windows(events: DataFrame, cls: str = "event_type", window: str = "1 day",
                         watermark: str = "1 day") -> DataFrame:
    """Z3: rolling class counts per tumbling window."""
    return (events.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w"), F.col(cls).alias("cls"))
            .agg(F.count(F.lit(1)).alias("n")))


class StreamTable:
    """A stream's result as a Parquet table on shared storage, in append mode, with its checkpoint.

    In append mode a window is written once, when the watermark has passed it, and its state is dropped then;
    later rows of that window no longer count.  Nothing passes through the driver."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        run = uuid.uuid4().hex
        self.path = scratch_path(spark, f"stream-{name}-{run}")
        self.checkpoint = scratch_path(spark, f"stream-ckpt-{run}")

    def advance(self, stream_df: DataFrame) -> None:
        """Read what the source has now (availableNow: as many micro-batches as it deals out), resuming where
        the checkpoint ends."""
        q = (stream_df.writeStream.format("parquet").outputMode("append").option("path", self.path)
             .option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()

    def read(self, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path)


def run_to_table(stream_df: DataFrame, name: str = "out") -> DataFrame:
    """Drive a stream over all its source holds and return the table written."""
    table = StreamTable(stream_df.sparkSession, name)
    table.advance(stream_df)
    return table.read(stream_df.schema)


class WindowTable:
    """Counts per event-time window and key on shared storage, kept right by upserts.

    ``upsert`` is a ``foreachBatch`` function: a micro-batch is counted, the counts are added to the totals of the
    windows it touches, and these windows' new totals become version ``batch id``.  A window's state is its newest
    version.  Totals are taken from versions before the batch's own, and the write replaces that version, so a batch
    that runs again after a failure writes the same rows.  No watermark is needed: no event is too late.
    ``compact`` merges what has settled into one version, so reading stays bounded by the windows there are."""

    def __init__(self, spark: SparkSession, name: str, count, schema: str, root: str | None = None):
        """``count``: frame of events -> frame (w, keys..., n), one row per window and key; ``schema`` of it."""
        self.spark, self.count = spark, count
        self.root = root or scratch_path(spark, f"windows-{name}-{uuid.uuid4().hex}")
        self.checkpoint = f"{self.root}-checkpoint"
        self.schema = f"{schema}, version long"
        self.keys = [c.strip().split(" ")[0] for c in schema.split(",")][:-1]

    def _versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.root)
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("w").agg(F.max("version").alias("last"))
        return rows.join(last.withColumnRenamed("w", "w_"), F.col("w").eqNullSafe(F.col("w_")) & (F.col("version") == F.col("last")))

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        added = self.count(batch)
        touched = added.select(F.col("w").alias("t")).distinct()
        before = self._versions().filter(F.col("version") < batch_id)
        old = self._newest(before.join(touched, F.col("w").eqNullSafe(F.col("t")), "left_semi")).select(*self.keys, "n")
        total = added.select(*self.keys, "n").union(old).groupBy(*self.keys).agg(F.sum("n").cast("long").alias("n"))
        total.write.mode("overwrite").parquet(f"{self.root}/version={batch_id}")

    def advance(self, events: DataFrame) -> None:
        """Read what the source has now, resuming where the checkpoint ends."""
        q = (events.writeStream.foreachBatch(self.upsert).outputMode("update")
             .option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()

    def read(self) -> DataFrame:
        return self._newest(self._versions()).select(*self.keys, "n")

    def compact(self) -> "WindowTable":
        """A table with one version that holds the present state, in a folder of its own; the old one is untouched and
        the stream goes on from the same checkpoint."""
        out = WindowTable(self.spark, "compact", self.count, self.schema.rsplit(",", 1)[0])
        out.checkpoint = self.checkpoint
        last = self._versions().agg(F.max("version")).first()[0]
        if last is not None:
            self.read().write.mode("overwrite").parquet(f"{out.root}/version={last}")
        return out


def day_counts(key, window: str = "1 day"):
    """Events -> (w, key, n) per window; events without a time are not in any."""
    def count(events: DataFrame) -> DataFrame:
        return (events.filter(F.col("ts").isNotNull()).groupBy(F.window("ts", window).start.alias("w"), key.alias("key"))
                .agg(F.count(F.lit(1)).alias("n")))
    return count


# ----------------------------------------------------------------- drift
DRIFT_SCHEMA = "w timestamp, n long, mean_conf double, l1_drift double"


def window_histograms(events: DataFrame, conf, window: str = "1 day", watermark: str = "1 day", n_bins: int = 10) -> DataFrame:
    """(stream, w, n, total, counts) of every closed window: the histogram of ``conf`` as one array."""
    b = ev.bin_index(conf, n_bins)
    cells = [F.count_if(b == i).alias(f"b{i}") for i in range(n_bins)]
    seen = (events.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(conf).alias("total"), *cells))
    return seen.select(F.lit("all").alias("stream"), F.col("w.start").alias("w"), "n", "total",
                       F.array(*[F.col(f"b{i}") for i in range(n_bins)]).alias("counts"))


def drift_processor(keep_days: int = 90):
    """State per stream: the last closed window and its histogram.  After more than ``keep_days`` without a window the
    next one counts as a first one; a timer on event time drops the state by then, so streams that end leave nothing."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    keep = keep_days * 86_400_000

    class Drift(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "at long, shares array<double>")

        def handleInputRows(self, key, rows, timerValues):
            found = pd.concat(list(rows)).sort_values("w")
            before, last = self.last.get() if self.last.exists() else (None, None)
            out = []
            for w, n, total, counts in zip(found["w"], found["n"], found["total"], found["counts"]):
                at, shares = int(w.timestamp() * 1000), [c / n for c in counts]
                fresh = before is None or at - before > keep
                out.append((w, int(n), total / n, None if fresh else sum(abs(a - b) for a, b in zip(shares, last))))
                before, last = at, shares
            self.last.update((before, last))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(before + keep + 1)
            yield pd.DataFrame(out, columns=["w", "n", "mean_conf", "l1_drift"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.last.clear()
            yield pd.DataFrame({"w": pd.Series(dtype="datetime64[ns]"), "n": pd.Series(dtype="int64"),
                                "mean_conf": pd.Series(dtype="float64"), "l1_drift": pd.Series(dtype="float64")})

        def close(self) -> None:
            pass
    return Drift()


def drift_stream(events: DataFrame, conf, keep_days: int = 90, **windows) -> DataFrame:
    """E9 on a stream: per closed window its size, mean confidence and L1 distance to the window before (null for the
    first).  Histograms are aggregated over all tasks; only one row per closed window reaches the keyed state."""
    return (window_histograms(events, conf, **windows).groupBy("stream")
            .transformWithStateInPandas(drift_processor(keep_days), outputStructType=DRIFT_SCHEMA, outputMode="Append", timeMode="EventTime"))


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class rocksdb_state:
    """Within this context streams are started with the state store that keyed state needs."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(self.KEY)
        self.conf.set(self.KEY, STATE_STORE)

    def __exit__(self, *_):
        self.conf.set(self.KEY, self.before)


def score_stream(model, ledger_stream: DataFrame, k: int = 3) -> DataFrame:
    """Streaming feature derivation and top-k scoring with a fitted model."""
    return model.classify(ledger_stream, k=k, keep=["txn_id"])
