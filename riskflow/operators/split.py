"""Strict time split (D1-D3): exact order-statistic cutoffs, ties go to the earlier split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import TEST, TEST_SIZE, TRAIN, VAL, VAL_SIZE
from .ordering import exact_kth

SPLIT_NAMES = ((TRAIN, "train"), (VAL, "val"), (TEST, "test"))  # fixed values


@dataclass(frozen=True)
class Cutoffs:
    n: int
    n_train: int
    n_val: int
    n_test: int
    train_max_t: int
    val_max_t: int


def split_sizes(n: int, test_size: float, val_size: float) -> tuple[int, int, int]:
    if not (0 < test_size < 1 and 0 <= val_size < 1 and test_size + val_size < 1):
        raise ValueError("need 0 < test_size < 1, 0 <= val_size < 1, test_size + val_size < 1")
    n_test = int(n * test_size)
    n_val = int(n * val_size)
    n_train = n - n_val - n_test
    if n == 0 or n_train <= 0:
        raise ValueError(f"time split needs at least one train row (n={n})")
    return n_train, n_val, n_test


def cutoffs(df: DataFrame, t: str = "unix_time", test_size: float = TEST_SIZE,
            val_size: float = VAL_SIZE) -> Cutoffs:
    """D1 cutoffs: the exact ``n_train``-th and ``(n_train + n_val)``-th smallest times."""
    times = df.select(F.col(t).cast("bigint").alias(t))

    def ranks(n):
        n_train, n_val, _ = split_sizes(n, test_size, val_size)
        return [n_train, n_train + n_val]

    n, (c1, c2) = exact_kth(times, t, ranks)
    n_train, n_val, n_test = split_sizes(n, test_size, val_size)
    return Cutoffs(n, n_train, n_val, n_test, c1, c2)


def label_split(df: DataFrame, cut: Cutoffs, t: str = "unix_time", out: str = "split") -> DataFrame:
    return df.withColumn(out, F.when(F.col(t) <= cut.train_max_t, F.lit(TRAIN))
                                .when(F.col(t) <= cut.val_max_t, F.lit(VAL))
                                .otherwise(F.lit(TEST)))


def time_split(df: DataFrame, t: str = "unix_time", test_size: float = TEST_SIZE,
               val_size: float = VAL_SIZE, out: str = "split") -> DataFrame:
    """Label each row 0/1/2 by its own time against exact cutoffs."""
    return label_split(df, cutoffs(df, t, test_size, val_size), t, out)


def split_names(spark) -> DataFrame:
    return spark.createDataFrame(list(SPLIT_NAMES), "split int, split_name string")


def split_summary(df: DataFrame, y: str = "is_fraud") -> DataFrame:
    """Rows and fraud rate per split; an empty split reports 0 rows and rate 0.0."""
    agg = df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col(y).cast("double")).alias("fraud_rate"))
    names = F.broadcast(split_names(df.sparkSession))  # three fixed rows
    return (names.join(agg, "split", "left")
                 .select("split", "split_name",
                         F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"),
                         F.coalesce("fraud_rate", F.lit(0.0)).alias("fraud_rate")))


def split_bounds(df: DataFrame, t: str = "unix_time") -> DataFrame:
    """D3: min / max time per split and the no-leak check max(train) < min(val) < min(test)."""
    b = df.groupBy("split").agg(F.min(t).alias("min_t"), F.max(t).alias("max_t"))
    # the aggregate has at most 3 rows, so an unpartitioned window over it is bounded
    nxt = F.lead("min_t").over(Window.partitionBy(F.lit(0)).orderBy("split"))
    return b.select("split", "min_t", "max_t",
                    F.coalesce(F.col("max_t") < nxt, F.lit(True)).alias("ordered"))
