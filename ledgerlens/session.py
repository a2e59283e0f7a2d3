"""Session helpers: recommended configuration and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every ledgerlens job relies on.  AQE re-plans joins and coalesces
# small shuffle partitions at runtime; skew-join splits hot partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings ledgerlens expects (safe to call twice)."""
    for key, value in RECOMMENDED_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "ledgerlens",
                  shuffle_partitions: int = 8, checkpoint: str | None = None) -> SparkSession:
    """A local session for tests and the bench (no UI, UTC, AQE on).

    ``checkpoint`` sets ``spark.checkpoint.dir`` (only possible at build time)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    if checkpoint:
        builder = builder.config("spark.checkpoint.dir", checkpoint)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_PRIVATE: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is given by the deployment and only read here; without it a job stops, since
    executors could not see a folder of this machine.  Only a local session (one JVM, as in tests) gets a
    private folder, once per application."""
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = sc.applicationId
        if app not in _PRIVATE:
            _PRIVATE[app] = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
        current = _PRIVATE[app]
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)


def written(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: computed once, with a measured size.

    Readers share a table out by files, at best; ``rows_per_file`` bounds these where a row costs much to work on."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
