"""Model registry as tables.

A registry root holds one folder per version (model artefacts) plus two
append-only tables:

* ``manifests``  -- version, created_at, config MAP<STRING,STRING>, metrics
  MAP<STRING,DOUBLE>, num_categories, n_features, checksums MAP<STRING,STRING>,
  status;
* ``promotions`` -- a commit log: file ``n`` holds the n-th promotion (version,
  promoted_at).

A promotion claims the next number by creating its file only if it is absent;
whoever loses the race takes the number after.  So any promotions that run at
once end up in one order, which every reader sees alike, and the active version
is the last one of it.  Checksums are hash trees over blocks (``hashing``); the
blocks' hashes are kept in table ``blocks``, so a check names what is altered.
"""

from __future__ import annotations

import datetime as _dt
import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import block_hashes, differences, roots

MANIFEST_SCHEMA = T.StructType([
    T.StructField("version", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("config", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()), True),
    T.StructField("num_categories", T.IntegerType(), True),
    T.StructField("n_features", T.IntegerType(), True),
    T.StructField("checksums", T.MapType(T.StringType(), T.StringType()), True),
    T.StructField("status", T.StringType(), True),
])
PROMOTION_SCHEMA = T.StructType([
    T.StructField("n", T.LongType(), False),
    T.StructField("version", T.StringType(), False),
    T.StructField("promoted_at", T.TimestampType(), False),
])


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with ``text``, unless one of that name exists: then False and nothing is changed.

    A local path is linked into place (complete from its first moment on); other stores give the guarantee by their
    file system's exclusive create."""
    local = path.removeprefix("file://") if path.startswith("file:///") else path
    if "://" not in local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        draft = f"{os.path.dirname(local)}/.draft-{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            f.write(text)
        try:
            os.link(draft, local)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = fs.create(target, False)
    except Py4JJavaError as err:
        if "AlreadyExists" in err.java_exception.getClass().getName() or fs.exists(target):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


class ModelRegistry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._loaded: str | None = None

    # ----------------------------------------------------------- tables
    @property
    def manifests_path(self) -> str:
        return f"{self.root}/manifests"

    @property
    def promotions_path(self) -> str:
        return f"{self.root}/promotions"

    def version_path(self, version: str) -> str:
        return f"{self.root}/versions/{version}"

    def _read(self, reader, path: str, schema: T.StructType) -> DataFrame:
        try:
            return reader(path)
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":          # any other failure is one
                raise
            return self.spark.createDataFrame([], schema)

    def manifests(self) -> DataFrame:
        return self._read(self.spark.read.schema(MANIFEST_SCHEMA).parquet, self.manifests_path, MANIFEST_SCHEMA)

    def promotions(self) -> DataFrame:
        """(n, version, promoted_at) of every promotion; an entry whose text is still being written is not there
        yet."""
        rows = self._read(self.spark.read.schema(PROMOTION_SCHEMA).json, self.promotions_path, PROMOTION_SCHEMA)
        return rows.filter("n is not null and version is not null")

    # ------------------------------------------------------------- write
    @staticmethod
    def new_version(now: _dt.datetime | None = None) -> str:
        now = now or _dt.datetime.now(_dt.timezone.utc)
        return "v-" + now.strftime("%Y%m%d-%H%M%S-%f")

    def _blocks(self, version: str) -> DataFrame:
        """(file, block, sha256) of the files under the version folder, as they are now."""
        name = F.regexp_replace(F.col("path"), r"^.*?/versions/[^/]+/", "")
        return block_hashes(self.spark, self.version_path(version), name)

    def recorded_blocks(self, version: str) -> DataFrame:
        """The same as they were when the version was registered."""
        schema = T.StructType([T.StructField("version", T.StringType()), T.StructField("file", T.StringType()),
                               T.StructField("block", T.LongType()), T.StructField("sha256", T.StringType())])
        rows = self._read(self.spark.read.schema(schema).parquet, f"{self.root}/blocks", schema)
        return rows.filter(F.col("version") == version).select("file", "block", "sha256")

    def checksums(self, version: str) -> DataFrame:
        """C14: (file, sha256) of every file under the version folder: the root of its hash tree."""
        return roots(self._blocks(version))

    def register(self, version: str, config: dict, metrics: dict, num_categories: int,
                 n_features: int, status: str = "candidate",
                 created_at: _dt.datetime | None = None) -> dict:
        """Append the manifest of an already written version folder."""
        self._blocks(version).select(F.lit(version).alias("version"), "*").write.mode("append").parquet(f"{self.root}/blocks")
        sums = {r["file"]: r["sha256"] for r in roots(self.recorded_blocks(version)).collect()}
        row = {
            "version": version,
            "created_at": created_at or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None),
            "config": {str(k): str(v) for k, v in config.items()},
            "metrics": {str(k): float(v) for k, v in metrics.items() if v is not None},
            "num_categories": int(num_categories), "n_features": int(n_features),
            "checksums": sums, "status": status,
        }
        self.spark.createDataFrame([row], MANIFEST_SCHEMA).coalesce(1) \
            .write.mode("append").parquet(self.manifests_path)
        return row

    def promote(self, version: str, at: _dt.datetime | None = None) -> int:
        """Unknown version → error; otherwise the next entry of the promotion log, whose number is returned.

        A number that another promotion claims first is given up for the next one."""
        known = self.manifests().filter(F.col("version") == version).limit(1).count()
        if not known:
            raise FileNotFoundError(f"no version {version} in this registry")
        at = at or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        n = 0
        while True:
            n = max(n, self.promotions().agg(F.max("n")).first()[0] or 0) + 1
            entry = json.dumps({"n": n, "version": version, "promoted_at": at.isoformat()})
            if create_if_absent(self.spark, f"{self.promotions_path}/{n:012d}.json", entry):
                return n

    # -------------------------------------------------------------- read
    def versions(self) -> DataFrame:
        """R2 / K6: versions, newest first."""
        return self.manifests().select("version", "created_at", "status") \
                   .orderBy(F.desc("version"))

    def active(self) -> str | None:
        """The version of the last promotion."""
        row = self.promotions().agg(F.max_by("version", "n").alias("v")).first()
        return row["v"] if row else None

    def mark_loaded(self, version: str) -> None:
        self._loaded = version

    def has_update(self) -> bool:
        """Is the active version different from the loaded one?"""
        act = self.active()
        return act is not None and act != self._loaded

    def verify(self, version: str) -> None:
        """Every recorded block must be there with the recorded hash; the error names those that are not."""
        try:
            bad = differences(self.recorded_blocks(version), self._blocks(version)).filter("state <> 'added'").collect()
        except Exception as err:  # noqa: BLE001  (a file the scan cannot read is corrupt)
            raise RuntimeError(f"version {version} cannot be read back: {str(err)[:300]}") from err
        if bad:
            say = lambda state: ", ".join(f"{r['file']} (block {r['block']})" for r in sorted(bad) if r["state"] == state)[:2000] or "none"
            kind = FileNotFoundError if any(r["state"] == "absent" for r in bad) else RuntimeError
            raise kind(f"version {version} is not what was registered; absent: {say('absent')}, altered: {say('altered')}")


def save_bundle(registry: ModelRegistry, model, metrics: dict, config: dict,
                version: str | None = None) -> dict:
    """Write a fitted ``LedgerModel`` (classifier, labels, vocabularies, date modes, feature means, rule
    profile) into a new version folder and register its manifest."""
    version = version or registry.new_version()
    base = registry.version_path(version)
    if model.kind in ("boosted", "forest"):
        model.classifier.save(f"{base}/classifier")
    else:
        model.classifier.write().overwrite().save(f"{base}/classifier")
    model.labels.write().overwrite().save(f"{base}/labels")
    if model.features.tfidf is not None:
        model.features.tfidf.save(f"{base}/text")
    spark = registry.spark
    meta = {"kind": model.kind, "date_modes": model.features.date_features.modes,
            "families": list(model.features.families), "baseline_accuracy": model.baseline_accuracy,
            "metrics": {k: v for k, v in metrics.items() if v is not None}, "train_seconds": model.train_seconds,
            "profile": model.features.domain.profile.source,
            "means": None if model.means is None else [float(m) for m in model.means]}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
        .write.mode("overwrite").text(f"{base}/meta")
    width = (model.features.tfidf.width if model.features.tfidf is not None else 0)
    n_dense = len(model.features.dense_pairs())
    return registry.register(version, config, metrics, len(model.classes), width + n_dense)


def load_bundle(registry: ModelRegistry, version: str | None = None):
    """The ``LedgerModel`` of a version (default: the active one), checked against its recorded hashes."""
    import numpy as np
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.feature import StringIndexerModel

    from ..plans.learn import FeatureModel, LedgerModel
    from .boosting import SoftmaxModel
    from .features import DateFeatures
    from .forest import ForestModel
    from .profile import DomainFeatures, Profile
    from .tfidf import TfidfModel
    version = version or registry.active()
    if version is None:
        raise FileNotFoundError("no version of this registry is promoted")
    registry.verify(version)
    base = registry.version_path(version)
    meta = json.loads(registry.spark.read.text(f"{base}/meta").first()[0])
    labels = StringIndexerModel.load(f"{base}/labels")
    own = {"boosted": SoftmaxModel, "forest": ForestModel}
    if meta["kind"] in own:
        classifier = own[meta["kind"]].load(registry.spark, f"{base}/classifier")
    else:
        classifier = LogisticRegressionModel.load(f"{base}/classifier")
    text = TfidfModel.load(registry.spark, f"{base}/text") if "text" in meta["families"] else None
    features = FeatureModel(DateFeatures(meta["date_modes"]), DomainFeatures(Profile.from_dict(meta["profile"])),
                            text, tuple(meta["families"]))
    registry.mark_loaded(version)
    return LedgerModel(features, labels, classifier, meta["train_seconds"], meta["metrics"], meta["baseline_accuracy"],
                       meta["kind"], None if meta["means"] is None else np.array(meta["means"]))


def default_root(spark: SparkSession) -> str:
    """A registry folder of its own under the shared folder."""
    from ..session import scratch_path
    return scratch_path(spark, f"registry-{uuid.uuid4().hex}")
