"""Alert-rate metric (L5) and spike alarm (L6); the same code serves batch and streaming input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

METRIC_SECONDS = 30     # fixed values: metric flush period, alarm period, limit, periods in a row
ALARM_SECONDS = 60
ALARM_LIMIT = 0.05
ALARM_PERIODS = 3


def alert_rate(scored: DataFrame, t: str = "unix_time", flag: str = "flag", seconds: int = METRIC_SECONDS) -> DataFrame:
    """Per tumbling ``seconds`` window: total scored, alerts, and alerts / total.

    Only windows with at least one row exist, so an empty window emits nothing.
    """
    start = F.col(t) - F.pmod(F.col(t), F.lit(seconds))
    return scored.groupBy(start.alias("window_start")).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col(flag).cast("int")).cast("bigint").alias("alerts")
    ).withColumn("rate", F.col("alerts") / F.col("total"))


def alert_rate_stream(scored: DataFrame, ts: str = "event_time", flag: str = "flag", seconds: int = METRIC_SECONDS,
                      delay: str = "0 seconds", real: Column | None = None) -> DataFrame:
    """L5 on a stream: event-time tumbling windows, appended once the watermark passes them.

    Rows outside ``real`` (end markers) move the watermark but are not counted; a window of such rows alone is
    not emitted. A marker a window's length and the delay past the last row brings out the last window.
    """
    return _rate_windows(scored, ts, flag, seconds, delay, real).select(
        F.unix_seconds(F.col("w.start")).alias("window_start"), "total", "alerts", "rate")


def _rate_windows(scored: DataFrame, ts: str, flag: str, seconds: int, delay: str, real: Column | None) -> DataFrame:
    real = F.lit(True) if real is None else real
    return (scored.withWatermark(ts, delay)
                  .groupBy(F.window(ts, f"{seconds} seconds").alias("w"))
                  .agg(F.count(F.when(real, 1)).alias("total"), F.count(F.when(real & F.col(flag), 1)).alias("alerts"))
                  .where("total > 0")
                  .withColumn("rate", F.col("alerts") / F.col("total")))


def alarm(points: DataFrame, period: int = ALARM_SECONDS, limit: float = ALARM_LIMIT,
          periods: int = ALARM_PERIODS) -> DataFrame:
    """Periods whose average metric point exceeds ``limit`` for ``periods`` periods in a row.

    A period without points is not breaching. Consecutive periods are matched by equi-joins on
    the period start (no dense spine and no unpartitioned window over time).
    """
    per = points.groupBy((F.col("window_start") - F.pmod(F.col("window_start"), F.lit(period))).alias("period")) \
                .agg(F.avg("rate").alias("avg_rate"))
    breach = per.where(F.col("avg_rate") > F.lit(limit))
    out = breach
    for i in range(1, periods):
        prev = breach.select((F.col("period") + F.lit(i * period)).alias("period"))
        out = out.join(prev, "period", "left_semi")
    return out


class Breaches(StatefulProcessor):
    """Periods above the limit that end a row of ``periods`` of them; its state is the last such period and the row's length."""

    def __init__(self, period: int, limit: float, periods: int):
        self.period, self.limit, self.periods = period, limit, periods

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "period long, length long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("period")
        last, length = self.last.get() or (None, 0)
        out = []
        for start, rate in zip(found["period"].tolist(), found["avg_rate"].tolist(), strict=True):
            if rate > self.limit:
                length = length + 1 if last == start - self.period else 1       # a missing or quiet period breaks the row
                last = start
                if length >= self.periods:
                    out.append((start, rate))
        if last is not None:
            self.last.update((int(last), int(length)))
        yield pd.DataFrame(out, columns=["period", "avg_rate"]).astype({"period": "int64", "avg_rate": "float64"})

    def close(self) -> None:
        pass


def alarm_stream(scored: DataFrame, ts: str = "event_time", flag: str = "flag", seconds: int = METRIC_SECONDS, period: int = ALARM_SECONDS,
                 limit: float = ALARM_LIMIT, periods: int = ALARM_PERIODS, delay: str = "0 seconds", real: Column | None = None) -> DataFrame:
    """L6 on a stream: windows of the metric, averaged per period, and the state of one detector: ``period, avg_rate``.

    The watermark closes the metric's windows and, through their end times, the periods; a period's row goes to one
    detector, one row per period whatever the number of transactions. A period without points has no row and resets it.
    """
    from ..session import ship_package
    from .stateful import STATE_CONF
    for k, v in STATE_CONF.items():
        scored.sparkSession.conf.set(k, v)
    ship_package(scored.sparkSession)
    points = _rate_windows(scored, ts, flag, seconds, delay, real)
    per = points.groupBy(F.window(F.window_time("w"), f"{period} seconds").alias("p")).agg(F.avg("rate").alias("avg_rate"))
    rows = per.select(F.lit(0).alias("detector"), F.unix_seconds(F.col("p.start")).alias("period"), "avg_rate")
    return rows.groupBy("detector").transformWithStateInPandas(Breaches(period, limit, periods), "period long, avg_rate double", "Append", "None")
