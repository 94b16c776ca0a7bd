"""Registered streaming queries (A6-A8, L1-L4, L7): each replays the card transactions through
Structured Streaming (``availableNow``) and returns the sink read back as a table. Replay must equal
batch, so the oracles are the batch SQL."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.adapters import tx_events
from ..streaming.jobs import run_stream
from ..streaming.replay import STREAM_TX, write_replay
from ..streaming.shards import read_shards, write_shards
from ..streaming.stateful import finalize
from . import oracle_sql as O
from .catalog import _feat_sql, _memo, processed, register, with_sql
from .catalog_serving import ALERTS_SQL, fallback_sql, tuned_threshold
from .present import present

def _run(spark, sf, late_every: int = 0):
    def make():
        src, rows = scratch_path(spark, "replay"), scratch_path(spark, "transactions")
        tx_events(spark, sf).write.parquet(rows)        # joined once; the replay and the lookups read it several times
        tx = spark.read.parquet(rows)
        info = write_replay(tx, src, late_every=late_every)
        # rows moved to the next file wait for at most one file's time span
        delay = info["span"] + 1 if late_every else 0
        run = run_stream(spark, src, processed(spark, sf), tuned_threshold(spark, sf), delay_seconds=delay,
                         history=None if late_every else tx, metric_delay_seconds=info["span"] + 1)
        run.span = info["span"]
        return run
    return _memo(spark, sf, f"stream-{late_every}", make)


def _features(run, spark):
    f = finalize(spark.read.parquet(run.features))
    return present(f.select("user", "unix_time", "tie", *O.NUMERIC), {c: 4 for c in O.NUMERIC})


@register("stream_features", _feat_sql(O.NUMERIC))
def q_stream_features(spark, sf):
    """L1 (+ A6/A7): ordered replay -> keyed O(1) state per card -> causal features; equals batch."""
    return _features(_run(spark, sf), spark)


@register("stream_late", _feat_sql(O.NUMERIC))
def q_stream_late(spark, sf):
    """L4: the replay with every 10th transaction moved one file later; the watermark delay covers
    the disorder, rows wait in state until it passes, and the output still equals batch."""
    return _features(_run(spark, sf, late_every=10), spark)


@register("stream_alerts", with_sql(ALERTS_SQL, f"""
SELECT alert_id, card_id, {O.RND('score')} AS score, {fallback_sql('score')} AS action FROM alerts WHERE error IS NULL"""))
def q_stream_alerts(spark, sf):
    """L2/L3/L7 + A8: streamed features scored with the batch fit, flagged rows emitted as alert JSON,
    each micro-batch parsed and triaged in ``foreachBatch``."""
    run = _run(spark, sf)
    a = spark.read.parquet(run.alerts)
    return present(a.select("alert_id", "card_id", "score", F.col("decision.action").alias("action")))


SHARD_ROWS = 2000       # records of a shard in the query below, about: 20 polls at any size


@register("shard_stream", with_sql(O.TX, "SELECT " + ", ".join(f.name if f.name != "user_id" else "NULL AS user_id" for f in STREAM_TX.fields) + " FROM tx"))
def q_shard_stream(spark, sf):
    """Transactions written as shards and polled to their ends, at most 100 records of a shard at a time; the query is
    stopped after some polls and started again from its checkpoint, and no record is lost or read twice."""
    base, tx = scratch_path(spark, "shards"), tx_events(spark, sf)
    write_shards(tx, f"{base}/in", max(4, -(-tx.count() // SHARD_ROWS)))

    def start():
        rows = read_shards(spark, f"{base}/in", starting="earliest").drop("event_time")
        return rows.writeStream.format("parquet").option("checkpointLocation", f"{base}/ckpt").start(f"{base}/out")

    first = start()
    while first.isActive and (first.lastProgress is None or first.lastProgress.batchId < 3):
        time.sleep(0.1)
    first.stop()
    again = start()
    again.processAllAvailable()
    again.stop()
    if again.lastProgress is None or again.lastProgress.batchId <= 3:
        raise RuntimeError("the second query did not go on from the first one's checkpoint")
    return spark.read.parquet(f"{base}/out").withColumn("user_id", F.col("user_id").cast("int"))
