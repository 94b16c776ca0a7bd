"""Shared plumbing of the operators: pruned inputs and tables cut out of the lineage."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, remove_path, scratch_path, ship_package
from ..sources.tables import read_table


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", list(cols) or ["doc_id", "text"])


#: bytes of rows that travel to a Python worker at a time: whole texts, so that long ones do not pile up
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(df: DataFrame) -> SparkSession:
    """The frame's session, with the package on its workers, the shared folder known and Arrow batches small."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    ship_package(spark)
    if int(str(spark.conf.get(_BATCH_CONF)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return spark


@contextlib.contextmanager
def stashed(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` written once as Parquet to the shared folder and reread; deleted at the end of the block."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove_path(spark, path)


#: ids that are sent to every task, at most (16 MB of longs); more are joined by a shuffle
BROADCAST_IDS = 1_000_000


def kept_rows(df: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``df`` without the rows whose ``id_col`` is in ``gone`` (one column); rows with a null id stay."""
    gone = gone.distinct().checkpoint()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return df.join(gone, id_col, "left_anti")
