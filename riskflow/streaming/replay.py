"""Time-ordered backfill (A7) and the file stream source that reads it.

The backfill writes the history as JSON files, one per time range, whose modification times follow the time
ranges, so a file stream read with ``maxFilesPerTrigger`` replays it as ordered micro-batches. The number of
ranges follows the number of rows. A file system that cannot set modification times needs a watermark delay
of at least one range (``span`` in the returned facts). On a cluster the same rows would go to a message bus keyed
by card (``read_bus``); what follows the source is the same.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import first_rows
from ..session import checkpoint_dir

# Label-free stream record (fixed schema, never inferred).
STREAM_TX = T.StructType([
    T.StructField("cc_num", T.StringType()), T.StructField("user_id", T.StringType()),
    T.StructField("unix_time", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("amt", T.DoubleType()),
    T.StructField("lat", T.DoubleType()), T.StructField("long", T.DoubleType()),
    T.StructField("merch_lat", T.DoubleType()), T.StructField("merch_long", T.DoubleType()),
    T.StructField("category", T.StringType()), T.StructField("gender", T.StringType()),
    T.StructField("state", T.StringType()),
])
SENTINEL_CARD = "__end_of_replay__"
FILE_ROWS = 1_000_000   # rows of one replay file, about
MIN_FILES = 8           # files of a small replay, so that it still has several micro-batches
AGE_MS = 4 * 86_400_000  # all modification times of a replay lie within this (a stream skips files a week older than its newest)


def _stamp(spark: SparkSession, path: str, now_ms: int) -> None:
    """Give the files of ``path/_file=<n>`` modification times in the order of n (one call for each file)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((int(f.getPath().getParent().getName().split("=")[1]), f.getPath().toString())
                   for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(path + "/_file=*/part-*")))
    step = max(1, min(1000, AGE_MS // max(1, len(found))))
    for i, (_, name) in enumerate(found):
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(name), now_ms - (len(found) - i) * step, -1)


def write_replay(tx: DataFrame, path: str, files: int | None = None, limit: int | None = None,
                 late_every: int = 0, late_by: int = 1, sentinels: bool = True, file_rows: int = FILE_ROWS) -> dict:
    """Write label-free rows as time-range JSON files, each ordered by (time, tie).

    ``files`` ranges of about equal counts (default: as many as ``file_rows`` asks for, ``MIN_FILES`` at least);
    rows of equal time are in one file. ``limit`` keeps the first N rows in time order (<= 0 or None: all).
    ``late_every`` > 0 moves every n-th row (by tie) ``late_by`` files on, a controlled out-of-order copy for the
    late-data test (L4). ``sentinels`` appends two far-future marker rows in two more files so the watermark passes
    every real row. Returns the number of files and rows, the largest time span of a file and the last time.
    """
    spark = tx.sparkSession
    checkpoint_dir(spark)
    x = tx.select(*[(F.col(f.name) if f.name in tx.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in STREAM_TX.fields])
    if limit and limit > 0:
        x = first_rows(x, ("unix_time", "tie"), limit)
    n = x.count()
    files = files or max(MIN_FILES, -(-n // file_rows))
    # the range partitioner's partition is the file; cut out of the lineage, so every later pass sees the same ranges
    x = x.repartitionByRange(files, "unix_time").withColumn("_file", F.spark_partition_id()).checkpoint()
    if late_every > 0:
        moved = F.least(F.col("_file") + late_by, F.lit(files - 1))
        x = x.withColumn("_file", F.when(F.pmod(F.col("tie"), F.lit(late_every)) == 0, moved).otherwise(F.col("_file")))
    facts = (x.groupBy("_file").agg(F.min("unix_time").alias("lo"), F.max("unix_time").alias("hi"))
             .agg(F.max(F.col("hi") - F.col("lo")).alias("span"), F.max("hi").alias("last")).first())
    span, last_t = int(facts["span"] or 0), int(facts["last"] or 0)
    (x.repartition("_file").sortWithinPartitions("_file", "unix_time", "tie").write.mode("append").partitionBy("_file").json(path))
    if sentinels:
        for j in (1, 2):
            row = {f.name: None for f in STREAM_TX.fields} | {"cc_num": SENTINEL_CARD, "unix_time": last_t + (span + 10) * 10 * j, "tie": -j}
            spark.createDataFrame([row], STREAM_TX).coalesce(1).write.mode("append").json(f"{path}/_file={files + j}")
    _stamp(spark, path, int(time.time() * 1000))
    return {"files": files, "rows": n, "span": span, "last_t": last_t}


def read_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """The replay as a stream: explicit schema, bounded files per micro-batch."""
    return (spark.readStream.schema(STREAM_TX).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).json(path)
                 .withColumn("event_time", F.timestamp_seconds("unix_time")))


def read_bus(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None, starting: str = "earliest") -> DataFrame:
    """A6 from a message bus: JSON values of ``topic`` through Spark's kafka source (its package must be on the cluster)."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
              .option("startingOffsets", starting))
    reader = reader.option("maxOffsetsPerTrigger", max_offsets) if max_offsets else reader
    rows = reader.load().select(F.from_json(F.col("value").cast("string"), STREAM_TX).alias("r")).select("r.*")
    return rows.withColumn("event_time", F.timestamp_seconds("unix_time"))
