"""Streaming queries: features + score + alerts (L1-L3, L7, A8), the alert-rate metric (A9, L5) and the alarm.

The queries of a cascade run at the same time: alerts and metrics read the feature sink while features are written to it.
Every query has its own checkpoint under the shared ``spark.checkpoint.dir`` so a restart resumes
from the last committed batch with its state; a failure of the metric never stops scoring.
"""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import triage as K
from ..operators.encode import apply_categories, apply_scaler
from ..operators.features import finish_features
from ..operators.scoring import score
from ..plans.build import Processed
from ..session import scratch_path
from .rate import alarm_stream, alert_rate_stream
from .replay import SENTINEL_CARD, read_stream
from .stateful import stream_state_features


@dataclass
class StreamRun:
    source: str
    features: str
    alerts: str
    quarantine: str
    metrics: str
    checkpoints: str
    dropped_late: int = 0
    feature_seconds: float = 0.0        # wall time of the feature stream
    span: int = 0                       # largest time span of a source file, if known
    seconds: float = 0.0                # wall time of the whole cascade
    batches: list[dict] = field(default_factory=list)       # progress of the feature stream: batch, start, rows, late


class Progress(StreamingQueryListener):
    """Each batch of each query as Spark reports it, however many there are: number, start, input rows, late rows."""

    def __init__(self):
        self.batches: dict[str, list[dict]] = {}
        self.ended: dict[str, threading.Event] = {}

    def end_of(self, query: StreamingQuery) -> threading.Event:
        return self.ended.setdefault(str(query.runId), threading.Event())

    def of(self, query: StreamingQuery, wait_seconds: float = 60.0) -> list[dict]:
        """The batches of an ended query; events arrive in order, so all are there when its end is."""
        if not self.end_of(query).wait(wait_seconds):
            raise TimeoutError("the end of the query was not reported")
        return self.batches.get(str(query.runId), [])

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.setdefault(str(p.runId), []).append({"batch": p.batchId, "start": p.timestamp, "rows": p.numInputRows,
                                                          "late": sum(o.numRowsDroppedByWatermark for o in p.stateOperators)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()


def scored_stream(features: DataFrame, p: Processed, threshold: float) -> DataFrame:
    """L2: the batch fit's codes and scaler, then the scorer, on streamed features."""
    coded = apply_scaler(apply_categories(features, p.maps, list(p.spec.categorical), p.category_map), p.stats)
    return score(coded, threshold)


def is_real() -> Column:
    """Rows that are not end markers of a replay."""
    return F.col("user") != SENTINEL_CARD


def alert_batch(alerts: str, quarantine: str, found: K.Lookups | None = None):
    """Handler of one micro-batch of alert payloads: parse, enrich (K2, with the lookups ``found``), decide, write.

    Valid alerts go to ``alerts`` and the others, with their error, to ``quarantine``; a batch has one folder in each,
    so a repeated batch overwrites itself. A payload is decoded once; filters do not reach behind the kept rows.
    """
    def handle(payload: DataFrame, batch_id: int) -> None:
        parsed = K.parse_alerts(payload).persist()
        parsed.where("NOT valid").select("alert_id", "key", "value", "error").write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        decided = K.resolve(parsed.where("valid"))
        columns = ["alert_id", "key", "value", "card_id", "score", "decision"]
        if found is not None:
            decided = K.attach(decided, found)
            columns += K.ENRICHED
        decided.select(columns).write.mode("overwrite").parquet(f"{alerts}/batch={batch_id}")
        parsed.unpersist()

    return handle


def run_alerts(spark: SparkSession, payloads: str, history: DataFrame | None = None) -> StreamRun:
    """L7 alone: a stream of alert payload files (``alert_id``, ``key``, ``value``) through ``alert_batch`` to its end."""
    base = scratch_path(spark, "alert-stream")
    run = StreamRun(payloads, "", f"{base}/alerts", f"{base}/quarantine", "", f"{base}/ckpt")
    stream = spark.readStream.schema("alert_id long, key string, value string").parquet(payloads)
    found = None if history is None else K.lookups(history)
    (stream.writeStream.foreachBatch(alert_batch(run.alerts, run.quarantine, found))
           .option("checkpointLocation", f"{run.checkpoints}/alerts").trigger(availableNow=True).start()).awaitTermination()
    return run


def _drained(query: StreamingQuery) -> None:
    """Let a running query take all that is there, then end it."""
    query.processAllAvailable()
    query.stop()
    query.awaitTermination()


def run_stream(spark: SparkSession, source: str, p: Processed, threshold: float, delay_seconds: int = 0,
               max_files: int = 1, history: DataFrame | None = None, metric_delay_seconds: int = 0, pace_seconds: float = 0.0,
               shards: int | None = None) -> StreamRun:
    """Run the feature, alert and metric streams side by side until the source is used up.

    Alerts of a feature batch are parsed, enriched and written while later batches are read; what they are enriched with is
    looked up in ``history`` once, before the streams begin. ``pace_seconds`` starts a
    feature batch every so often (0: as soon as the last is done). ``dropped_late`` is what Spark reports as behind the
    watermark over all batches.
    """
    base = scratch_path(spark, "stream")
    run = StreamRun(source, f"{base}/features", f"{base}/alerts", f"{base}/quarantine", f"{base}/metrics", f"{base}/ckpt")
    features = finish_features(stream_state_features(read_stream(spark, source, max_files), delay_seconds, shards), p.spec)
    found = None if history is None else K.lookups(history)
    listener = Progress()
    spark.streams.addListener(listener)
    began = time.time()
    running: list[StreamingQuery] = []
    try:
        pace = {"processingTime": f"{pace_seconds} seconds"} if pace_seconds else {"availableNow": True}
        q1 = (features.writeStream.format("parquet").option("checkpointLocation", f"{run.checkpoints}/features")
                      .trigger(**pace).start(run.features))
        # scoring + alerts and the metric read the feature sink as streams of their own (own checkpoints)
        scored = scored_stream(spark.readStream.schema(features.schema).parquet(run.features), p, threshold)
        alerts = K.alert_payload(scored.where(is_real() & F.col("flag")).withColumn("amt", F.col("amt_raw")))
        q2 = (alerts.writeStream.foreachBatch(alert_batch(run.alerts, run.quarantine, found))
                    .option("checkpointLocation", f"{run.checkpoints}/alerts").start())
        # A failure of the metric never stops scoring
        metric_in = scored.withColumn("event_time", F.timestamp_seconds("unix_time"))
        rates = alert_rate_stream(metric_in, "event_time", "flag", delay=f"{int(metric_delay_seconds)} seconds", real=is_real())
        q3 = (rates.writeStream.format("parquet").outputMode("append")
                   .option("checkpointLocation", f"{run.checkpoints}/metrics").start(run.metrics))
        running = [q1, q2, q3]
        if pace_seconds:
            _drained(q1)
        else:
            q1.awaitTermination()
        run.feature_seconds = time.time() - began
        for q in (q2, q3):
            _drained(q)
        run.batches = listener.of(q1)
        run.dropped_late = sum(b["late"] for b in run.batches)
        run.seconds = time.time() - began
    finally:
        for q in running:
            q.stop()
        spark.streams.removeListener(listener)
    return run


def run_alarm(spark: SparkSession, features: str, p: Processed, threshold: float, delay_seconds: int = 0, **alarm) -> DataFrame:
    """The spike alarm over a feature sink read as a stream to its end; ``alarm`` are the options of ``alarm_stream``."""
    base = scratch_path(spark, "alarm-stream")
    scored = scored_stream(spark.readStream.schema(spark.read.parquet(features).schema).parquet(features), p, threshold)
    scored = scored.withColumn("event_time", F.timestamp_seconds("unix_time"))
    found = alarm_stream(scored, delay=f"{int(delay_seconds)} seconds", real=is_real(), **alarm)
    (found.writeStream.format("parquet").option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start(f"{base}/alarms")).awaitTermination()
    return spark.read.schema("period long, avg_rate double").parquet(f"{base}/alarms")
