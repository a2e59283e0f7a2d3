"""Content hashes of files in bounded memory (C14): a hash tree over fixed-size blocks.

A file is cut into blocks of ``BLOCK`` bytes.  A block's hash is its SHA-256; every ``FAN`` hashes of a level give one of
the next (SHA-256 of their hex digits in order), up to the file's root.  So a file of one block has its plain SHA-256,
and a changed byte is traced to its block.

Files up to ``WHOLE`` bytes are read by the ``binaryFile`` source and cut by Column expressions.  That source holds a whole
file in one row, so larger ones are read in ranges: fixed-length records of one block, dealt over tasks by the input
format.  It cannot end in the middle of a record; the remainder is read as records of a length that divides the file's.
No task holds more than a few blocks.  Empty files are passed over (the source does not list them).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK, FAN, WHOLE = 1 << 20, 1024, 32 << 20
TASK_BLOCKS = 64                # blocks a task reads of a large file
BLOCKS = "file string, block long, sha256 string"


def _records(spark: SparkSession, path: str, length: int, split: int):
    """RDD of (record number, bytes) of a file read as records of ``length`` bytes, in splits of about ``split``."""
    return spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable",
        "org.apache.hadoop.io.BytesWritable",
        conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(length),
              "mapreduce.input.fileinputformat.split.maxsize": str(split),
              "mapreduce.input.fileinputformat.split.minsize": str(split)})


def divisor(n: int, most: int) -> int:
    """Largest divisor of ``n`` that is at most ``most``."""
    best, i = 1, 1
    while i * i <= n and i <= most:
        if n % i == 0:
            best = max(best, i, n // i if n // i <= most else 1)
        i += 1
    return best


def range_hashes(spark: SparkSession, path: str, size: int, block: int = BLOCK) -> list[tuple[int, str]]:
    """(block, SHA-256) of a large file; one short row per block comes to the driver, the bytes stay in the tasks."""
    out, start = [], 0
    for split in (block * TASK_BLOCKS, block):                 # all but the last split hold whole blocks only
        if size <= split:
            continue
        rows = _records(spark, path, block, split)
        first, last = start // split, rows.getNumPartitions() - 1
        if last > first:
            out += spark.sparkContext.runJob(
                rows, lambda it: [(int(k), hashlib.sha256(bytes(v)).hexdigest()) for k, v in it], range(first, last))
            start = last * split
    step = divisor(size, 1 << 16)
    rows = _records(spark, path, step, max(step, block // step * step))
    near = [i for i in range(rows.getNumPartitions()) if i >= rows.getNumPartitions() - 4]
    tail = sorted(spark.sparkContext.runJob(
        rows, lambda it, s=start, n=step: [(int(k), bytes(v)) for k, v in it if (int(k) + 1) * n > s], near))
    rest = b"".join(v for _, v in tail)[start - size:] if start < size else b""
    return sorted(out) + [(start // block + i, hashlib.sha256(rest[a:a + block]).hexdigest())
                          for i, a in enumerate(range(0, len(rest), block))]


def block_hashes(spark: SparkSession, folder: str, name: Column, block: int = BLOCK, whole: int = WHOLE) -> DataFrame:
    """(file, block, sha256) of every block of every file under ``folder``; ``name`` makes ``file`` from column ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    last = F.greatest(F.ceil(F.col("length") / F.lit(block)).cast("int") - 1, F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(F.col("content"), i * block + 1, F.lit(block)), 256))
    small = files.filter(F.col("length") <= whole).select(name.alias("file"), F.posexplode(parts).alias("block", "sha256")).select(
        "file", F.col("block").cast("long").alias("block"), "sha256")
    large = files.filter(F.col("length") > whole).select("path", "length", name.alias("file")).collect()
    rows = [(r["file"], b, h) for r in large for b, h in range_hashes(spark, r["path"], r["length"], block)]
    return small.union(spark.createDataFrame(rows, BLOCKS)) if rows else small


def roots(blocks: DataFrame, fan: int = FAN) -> DataFrame:
    """(file, sha256): the root of each file's hash tree."""
    level = blocks.select("file", "block", "sha256")
    while level.filter(F.col("block") > 0).limit(1).count():
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "sha256"))), lambda s: s["sha256"]), "")
        many = F.max("block").over(Window.partitionBy("file")) > 0
        level = (level.withColumn("many", many).groupBy("file", "many", F.floor(F.col("block") / fan).cast("long").alias("up"))
                 .agg(joined.alias("joined"), F.first("sha256").alias("only"))
                 .select("file", F.col("up").alias("block"),
                         F.when(F.col("many"), F.sha2(F.col("joined").cast("binary"), 256)).otherwise(F.col("only")).alias("sha256")))
    return level.select("file", "sha256")


def differences(recorded: DataFrame, present: DataFrame) -> DataFrame:
    """(file, block, state) of the recorded blocks that are not as they were: absent, altered; and added ones."""
    old = recorded.select("file", "block", F.col("sha256").alias("was"))
    new = present.select("file", "block", F.col("sha256").alias("is"))
    state = F.when(F.col("is").isNull(), "absent").when(F.col("was").isNull(), "added").otherwise("altered")
    return old.join(new, ["file", "block"], "full").filter(~F.col("was").eqNullSafe(F.col("is"))).select("file", "block", state.alias("state"))
