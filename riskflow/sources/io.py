"""File sources and sinks: raw transaction files (A1/A2), the processed table and its fitted
tables (A3-A5), the scored feed (A10) and run-metric files (A11)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordering import running_totals
from ..schema import RAW_TX, USE_COLS
from ..session import checkpoint_dir, path_exists, scratch_path


#: bytes of the table of file blocks that are sent to every task; a larger one is joined by a shuffle
BLOCKS_BROADCAST_BYTES = 64 << 20
_PLACE = ("_entry", "_file", "_block")


def read_transactions(spark: SparkSession, paths: Sequence[str], fmt: str = "csv") -> DataFrame:
    """A1/A2: read every transaction file (or folder) that exists, on any file system Spark reaches, with an
    explicit schema, and keep the allow-list. Raises when none exists.

    ``tie`` numbers the rows 0, 1, 2, ...: by the list of paths, within a folder by the files' names, within a file by place.
    The files are read once, into a table under ``spark.checkpoint.dir`` in which each row has its file, its block (the
    part of a file that one task reads) and its number in its task. Rows of a block follow each other, so a row's tie is
    the number of rows in the blocks before, a running total over the blocks, plus its place in the block. What reads
    the rows afterwards reads that table, so their ties cannot change when files are cut otherwise or executors are lost.
    """
    found = [p for p in paths if path_exists(spark, p)]
    if not found:
        raise FileNotFoundError(f"none of the transaction files exists: {list(paths)}")
    schema = T.StructType([f for f in RAW_TX.fields if f.name != "tie"])
    reader = spark.read.schema(schema)
    columns = [c for c in USE_COLS if c in schema.names]
    parts = []
    for entry, path in enumerate(found):
        one = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
        parts.append(one.select(*columns, F.lit(entry).alias("_entry"), F.col("_metadata.file_path").alias("_file"),
                                F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")))
    landed = scratch_path(spark, "transactions")
    reduce(DataFrame.unionByName, parts).write.parquet(landed)
    rows = spark.read.parquet(landed)
    return rows.join(_rows_before(rows), list(_PLACE)).select(*columns, (F.col("_before") + F.col("_row") - F.col("_first")).alias("tie"))


def _rows_before(rows: DataFrame) -> DataFrame:
    """Per file block the rows of all blocks before it, in the order (list entry, file, block), and its first row number."""
    checkpoint_dir(rows.sparkSession)
    blocks = rows.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")).withColumn("_place", F.struct(*_PLACE)).checkpoint()
    size = blocks.agg(F.sum(F.octet_length("_file") + 64)).first()[0] or 0
    before = running_totals(blocks, "_place", ["_n"], prefix="_upto_").select(*_PLACE, "_first", (F.col("_upto__n") - F.col("_n")).alias("_before"))
    return F.broadcast(before) if size <= BLOCKS_BROADCAST_BYTES else before


def write_processed(table: DataFrame, path: str, key: str = "user") -> None:
    """A3: one table (split is a column), clustered by card so later per-card reads skip row groups.

    Ranges over (card, time, tie) hold equal counts of rows, so a hot card spreads over several files.
    """
    (table.repartitionByRange(key, "unix_time", "tie").sortWithinPartitions(key, "unix_time", "tie")
          .write.mode("overwrite").parquet(path))


def write_bucketed(table: DataFrame, name: str, path: str, buckets: int, key: str = "user") -> None:
    """A3 as a table of the session's catalog, in ``buckets`` buckets by card, each in (card, time, tie) order.

    What is partitioned by card (windows, last rows, profiles) reads such a table without a shuffle. A bucket is one file:
    choose the number so that the rows of a bucket fit a task; hot cards are still cut into chunks by what reads them.
    """
    (table.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, "unix_time", "tie")
          .option("path", path).saveAsTable(name))


def load_processed(spark: SparkSession, path: str, expected: T.StructType | None = None) -> DataFrame:
    """A5: read the processed table, checking names and types of the stored schema when one is expected."""
    df = spark.read.parquet(path)
    if expected is not None:
        stored = {f.name: f.dataType for f in df.schema.fields}
        missing = [f.name for f in expected.fields if f.name not in stored]
        if missing:
            raise ValueError(f"processed table lacks columns {missing}")
        wrong = [f"{f.name}: {stored[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in expected.fields if stored[f.name] != f.dataType]
        if wrong:
            raise ValueError(f"processed table has other types: {wrong}")
    return df


def write_fitted(tables: dict[str, DataFrame], path: str) -> None:
    """A4: fitted tables (category map, scaler, split stats) as small JSON tables."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def read_fitted(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """A4: read fitted tables back with their schemas."""
    return {name: spark.read.schema(s).json(f"{path}/{name}") for name, s in schemas.items()}


RUN_METRICS = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("features", T.StringType()),
    T.StructField("pr_auc", T.DoubleType()), T.StructField("roc_auc", T.DoubleType()),
    T.StructField("f1", T.DoubleType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("n_params", T.LongType()), T.StructField("error", T.StringType()),
])


def read_run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Run-metric JSON files into one table, with the file each row came from."""
    return spark.read.schema(RUN_METRICS).json(path).withColumn("source_file", F.col("_metadata.file_path"))
