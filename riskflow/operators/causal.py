"""One skew-safe pass of per-card causal window statistics.

The natural plan, ``Window.partitionBy(card).orderBy(time, tie)``, puts every row of a card in one
task. A card holding a third of all rows would then be a third of the job in one task. Here:

1. a small aggregate finds *hot* cards (more than ``hot_rows`` rows); there are at most
   ``rows / hot_rows`` of them, and the table is broadcast only below ``BROADCAST_MAX_ROWS``
   (checked), else joined by shuffle with AQE skew handling;
2. the hot cards' rows are range-partitioned on ``(card, time, tie)`` into chunks of about
   ``chunk_rows`` rows (Spark's range partitioner samples the bounds, so chunks hold equal counts
   even for bursts or many rows at one timestamp); the partition id, checkpointed so every later
   pass sees the same chunks, is the chunk. Ordinary cards keep chunk 0, and the windows run
   over ``(card, chunk)``: one hash exchange;
3. per-chunk totals (count, sums, last time, last L-1 vectors) of hot cards, one row per chunk,
   are turned into carries with a window over chunks and joined back: broadcast while the number
   of hot chunks is at most ``CARRY_BROADCAST_MAX`` (checked), else an ordinary join on
   ``(card, chunk)``, which the windowed side already satisfies (only the carries shuffle).

The result equals the plain per-card window for any data; the chunk machinery only adds work
when hot cards exist.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

HOT_ROWS = 2_000_000        # a card above this many rows is split into range chunks
CHUNK_ROWS = 500_000        # target rows per chunk of a hot card
MAX_CHUNKS = 100_000        # range partitions of hot rows at most; beyond that chunks grow
BROADCAST_MAX_ROWS = 500_000    # hot-card rows (key + count): tens of MB at most
CARRY_BROADCAST_MAX = 10_000  # hot chunks; a carry row holds up to L-1 feature vectors (a few KB)


def _ord(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc() for c in order]


def _chunked(df: DataFrame, key: str, order: Sequence[str], hot_rows: int, chunk_rows: int):
    hot = df.groupBy(key).agg(F.count(F.lit(1)).alias("_hn")).where(F.col("_hn") > hot_rows)
    size = hot.agg(F.count(F.lit(1)).alias("cards"), F.sum("_hn").alias("rows")).first()
    n_hot, n_rows = int(size["cards"]), int(size["rows"] or 0)
    if n_hot == 0:
        return df.withColumn("_chunk", F.lit(0)), 0
    side = F.broadcast(hot) if n_hot <= BROADCAST_MAX_ROWS else hot
    side = side.select(F.col(key).alias("_hot_key"), F.lit(True).alias("_hot"))
    flagged = df.join(side, F.col(key).eqNullSafe(F.col("_hot_key")), "left").drop("_hot_key")   # a null key may be hot too
    cold = flagged.where(F.col("_hot").isNull()).drop("_hot").withColumn("_chunk", F.lit(0))
    n_chunks = min(max(1, math.ceil(n_rows / chunk_rows)), MAX_CHUNKS)
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    chunks = (flagged.where(F.col("_hot").isNotNull()).drop("_hot")
                     .repartitionByRange(n_chunks, F.col(key), *_ord(order))
                     .withColumn("_chunk", (F.spark_partition_id() + 1).cast("int"))
                     .checkpoint(eager=True))
    return cold.unionByName(chunks), n_chunks


def _tail(arr: Column, n: int) -> Column:
    """Last ``n`` elements of an array (the whole array when shorter)."""
    return F.slice(arr, F.greatest(F.size(arr) - F.lit(n - 1), F.lit(1)), F.lit(n))


def near_targets(x: DataFrame, w: WindowSpec, targets: Column, seq_len: int) -> DataFrame:
    """The rows that the windows of target rows reach: those with a target among themselves and the next ``seq_len - 1`` rows.

    The look-ahead runs over the partitions and order of the windows to come, so it adds neither a shuffle nor a sort. The
    last rows of a hot key's chunk stay, as the targets that they belong to may be in the next chunk.
    """
    ahead = F.max(F.coalesce(targets, F.lit(False))).over(w.rowsBetween(0, seq_len - 1))
    last_of_chunk = (F.col("_chunk") > 0) & (F.count(F.lit(1)).over(w.rowsBetween(0, seq_len - 1)) < seq_len)
    return x.withColumn("_near", ahead | last_of_chunk).where("_near").drop("_near")


def causal_pass(df: DataFrame, key: str, order: Sequence[str], t: str = "unix_time",
                value: str | None = None, vec: str | None = None, seq_len: int | None = None,
                hot_rows: int = HOT_ROWS, chunk_rows: int = CHUNK_ROWS,
                carry_broadcast_max: int = CARRY_BROADCAST_MAX, targets: Column | None = None) -> DataFrame:
    """Add causal per-key columns, each computed from strictly earlier rows of the same key:

    ``_prior_n`` rows before, ``_prev_t`` previous time (null on the first row),
    with ``value``: ``_prior_sum`` / ``_prior_cnt`` over non-null values before,
    with ``vec`` and ``seq_len``: ``_win``, the last ``seq_len`` vectors ending at the row.

    With ``targets`` (a condition on rows) only target rows are returned, with ``_win`` alone: ``near_targets`` cuts the rows
    before the windows are collected.
    """
    x, n_chunks = _chunked(df, key, order, hot_rows, chunk_rows)
    has_hot = n_chunks > 0
    w = Window.partitionBy(key, "_chunk").orderBy(*_ord(order))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.row_number().over(w).alias("_rn"), F.lag(t).over(w).alias("_lprev_t")]
    if value:
        cols += [F.sum(value).over(before).alias("_lsum"), F.count(value).over(before).alias("_lcnt")]
    if vec:
        cols.append(F.collect_list(vec).over(w.rowsBetween(-(seq_len - 1), 0)).alias("_lwin"))
    local = (x if targets is None else near_targets(x, w, targets, seq_len)).select("*", *cols)

    if has_hot:
        # chunk summaries read the hot rows only (not the windowed table, which would repeat
        # the full shuffle); without vectors they are a plain partial aggregate
        hot_rows_df = x.where(F.col("_chunk") > 0)
        if vec:
            follow = F.count(F.lit(1)).over(w.rowsBetween(1, seq_len - 1))
            hot_rows_df = hot_rows_df.withColumn("_follow", follow)
        aggs = [F.count(F.lit(1)).alias("_cn"), F.max(t).alias("_ct")]
        if value:
            aggs += [F.sum(value).alias("_cs"), F.count(value).alias("_cc")]
        if vec:
            keep = F.when(F.col("_follow") < seq_len - 1, F.struct(*[F.col(c) for c in order], F.col(vec).alias("_v")))
            aggs.append(F.sort_array(F.collect_list(keep)).alias("_ctail"))
        summ = hot_rows_df.groupBy(key, "_chunk").agg(*aggs)
        cw = Window.partitionBy(key).orderBy("_chunk")
        prev = cw.rowsBetween(Window.unboundedPreceding, -1)
        carry = [F.sum("_cn").over(prev).alias("_carry_n"), F.max("_ct").over(prev).alias("_carry_t")]
        if value:
            carry += [F.sum("_cs").over(prev).alias("_carry_sum"), F.sum("_cc").over(prev).alias("_carry_cnt")]
        if vec:
            near = F.collect_list(F.transform("_ctail", lambda s: s["_v"])).over(cw.rowsBetween(-(seq_len - 1), -1))
            carry.append(_tail(F.flatten(near), seq_len - 1).alias("_carry_tail"))
        carries = summ.select(key, "_chunk", *carry)
        # at most one row per (card, chunk): a range chunk can hold the tail and head of two cards
        carries = carries.withColumnsRenamed({key: "_carry_key", "_chunk": "_carry_chunk"})
        side = F.broadcast(carries) if n_chunks <= carry_broadcast_max else carries
        local = local.join(side, F.col(key).eqNullSafe(F.col("_carry_key")) & (F.col("_chunk") == F.col("_carry_chunk")),
                           "left").drop("_carry_key", "_carry_chunk")
    else:
        for c in ("_carry_n", "_carry_t", "_carry_sum", "_carry_cnt"):
            local = local.withColumn(c, F.lit(None).cast("long"))

    out = local.select(
        "*",
        (F.coalesce(F.col("_carry_n"), F.lit(0)) + F.col("_rn") - 1).cast("long").alias("_prior_n"),
        F.coalesce(F.col("_lprev_t"), F.col("_carry_t")).alias("_prev_t"),
    )
    if value:
        out = out.select(
            "*",
            (F.coalesce(F.col("_lsum"), F.lit(0.0)) + F.coalesce(F.col("_carry_sum"), F.lit(0.0))).alias("_prior_sum"),
            (F.col("_lcnt") + F.coalesce(F.col("_carry_cnt"), F.lit(0))).alias("_prior_cnt"),
        )
    if vec and has_hot:
        full = F.when(F.col("_carry_tail").isNull() | (F.size("_lwin") >= seq_len), F.col("_lwin")) \
                .otherwise(_tail(F.concat(F.col("_carry_tail"), F.col("_lwin")), seq_len))
        out = out.withColumn("_win", full)
    elif vec:
        out = out.withColumn("_win", F.col("_lwin"))
    drop = [c for c in ("_rn", "_lprev_t", "_lsum", "_lcnt", "_lwin", "_follow", "_chunk",
                        "_carry_n", "_carry_t", "_carry_sum", "_carry_cnt", "_carry_tail") if c in out.columns]
    if targets is not None:                                     # counts and sums over the cut rows mean nothing
        out = out.where(targets)
        drop += [c for c in ("_prior_n", "_prev_t", "_prior_sum", "_prior_cnt") if c in out.columns]
    return out.drop(*drop)
