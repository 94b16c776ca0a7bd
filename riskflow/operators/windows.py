"""Causal, per-card, left-zero-padded sequence windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SPLIT_CODE
from .causal import CHUNK_ROWS, HOT_ROWS, causal_pass
from .encode import assemble

ORDER = ("unix_time", "tie")


def seq_windows(df: DataFrame, feature_cols: Sequence[str], seq_len: int, key: str = "user",
                order: Sequence[str] = ORDER, out: str = "window", hot_rows: int = HOT_ROWS,
                chunk_rows: int = CHUNK_ROWS, targets: Column | None = None) -> DataFrame:
    """G1: the ``seq_len`` rows of the same card ending at each row, oldest first, zero-padded left.

    Vectors are assembled before collecting, so a null feature never drops a step
    (``collect_list`` skips null elements, not arrays holding nulls). ``targets``: windows of the rows that meet it alone.
    """
    if seq_len < 1:
        raise ValueError("seq_len must be >= 1")
    x = df.withColumn("_vec", assemble(feature_cols))
    y = causal_pass(x, key, order, t=order[0], vec="_vec", seq_len=seq_len,
                    hot_rows=hot_rows, chunk_rows=chunk_rows, targets=targets)
    zero = F.array(*[F.lit(0.0).cast("float") for _ in feature_cols])
    pad = F.array_repeat(zero, F.lit(seq_len) - F.size("_win"))
    return y.withColumn(out, F.concat(pad, F.col("_win"))).drop("_vec", "_win", "_prior_n", "_prev_t")


def split_windows(df: DataFrame, which: str, feature_cols: Sequence[str], seq_len: int, **kw) -> DataFrame:
    """G3 (and G2): windows of one split's rows, with context from the full table.

    A val/test window may reach back into earlier train rows of its card. Rows that no target's window reaches are
    dropped by a look-ahead before the windows are collected.
    """
    if which not in SPLIT_CODE:
        raise ValueError(f"which must be one of {list(SPLIT_CODE)}, got {which!r}")
    return seq_windows(df, feature_cols, seq_len, targets=F.col("split") == SPLIT_CODE[which], **kw)


def pos_weight(df: DataFrame, y: str = "y") -> DataFrame:
    """Negatives / positives of the targets, 1.0 when there is no positive."""
    a = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    return a.select(F.when(F.coalesce("pos", F.lit(0)) > 0, (F.col("n") - F.col("pos")) / F.col("pos"))
                     .otherwise(F.lit(1.0)).alias("pos_weight"))


def window_fullness(df: DataFrame, seq_len: int, key: str = "user") -> DataFrame:
    """Share of cards, and of transactions, whose card has at least ``seq_len`` rows."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    full = (F.col("n") >= seq_len)
    return per.agg(
        F.count(F.lit(1)).alias("cards"),
        F.avg(full.cast("double")).alias("card_share"),
        (F.sum(F.when(full, F.col("n")).otherwise(0)) / F.sum("n")).alias("tx_share"),
    )
