"""Keyed stream state for causal per-card features (L1) with event-time ordering (L4).

Cards are dealt by hash to shards, and a shard is the key of the state processor, so a call handles the rows of many cards at
once. A shard's state:

* ``past``: for each card the rows seen, sum and count of non-null amounts, and the last time, as one packed table that a
  batch reads and writes once, about 50 bytes a card. It does not grow with the rows;
* ``runs``: the rows that wait for the watermark. What is left waiting of a batch is one run, sorted by time and filed under
  its earliest time, so a batch reads only the runs that it releases rows of, whatever else waits;
* an event-time timer at the earliest waiting time, for shards without new rows.

Rows are released in (time, tie) order once the watermark has passed them, so the emitted features equal the batch window's.
Rows that arrive behind the watermark are dropped by Spark and reported in the query progress (``numRowsDroppedByWatermark``).
``delay = 0`` releases rows as soon as a later batch arrives. State lies in RocksDB, with changes uploaded per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.keys import card_key
from .replay import SENTINEL_CARD, STREAM_TX

TEXT = {"cc_num", "user_id", "category", "gender", "state"}
INTS = {"unix_time", "tie"}
PASS = [f.name for f in STREAM_TX.fields if f.name not in ("unix_time", "tie", "amt")]
OUT_SCHEMA = ("user string, unix_time long, tie long, amt float, amt_raw double, "
              + ", ".join(f"{c} {'string' if c in TEXT else 'double'}" for c in PASS)
              + ", _prior_n long, _prev_t long, _prior_sum double, _prior_cnt long")
COLS = ["user", "unix_time", "tie", "amt", *PASS]
RUN = pa.schema([(c, pa.string() if c in TEXT or c == "user" else pa.int64() if c in INTS else pa.float64()) for c in COLS])

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
PAST = pa.schema([("user", pa.string()), ("n", pa.int64()), ("s", pa.float64()), ("nn", pa.int64()), ("last_t", pa.int64())])


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


class CausalState(StatefulProcessor):
    """Releases the waiting rows of a shard that the watermark has passed, with their cards' past."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getValueState("past", "body binary")
        self.runs = handle.getMapState("runs", "start long", "body binary")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [pa.Table.from_pandas(p[COLS], schema=RUN, preserve_index=False) for p in rows if len(p)]
        yield from self.released(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.released([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def released(self, new: list[pa.Table], watermark_ms: int) -> Iterator[pd.DataFrame]:
        starts = [k[0] for k in self.runs.keys()]
        due = [s for s in starts if s * 1000 < watermark_ms]
        for s in due:
            new.append(_unpacked(bytes(self.runs.getValue((s,))[0])))
            self.runs.removeKey((s,))
        waiting = [s for s in starts if s * 1000 >= watermark_ms]
        ready = None
        if new:
            rows = pa.concat_tables(new).sort_by([("unix_time", "ascending")])
            passed = int(np.searchsorted(rows["unix_time"].to_numpy() * 1000, watermark_ms, side="left"))
            ready, rest = rows.slice(0, passed), rows.slice(passed)
            if len(rest):
                start = rest["unix_time"][0].as_py()
                if start in waiting:
                    rest = pa.concat_tables([_unpacked(bytes(self.runs.getValue((start,))[0])), rest]).sort_by([("unix_time", "ascending")])
                self.runs.updateValue((start,), (_packed(rest),))
                waiting.append(start)
        if waiting:
            at = max(min(waiting) * 1000 + 1, watermark_ms + 1)
            set_for = self.timer.get()
            if set_for is None or set_for[0] != at:
                self.handle.registerTimer(at)
                self.timer.update((at,))
        if ready is not None and len(ready):
            yield self.with_past(ready)

    def with_past(self, rows: pa.Table) -> pd.DataFrame:
        """``OUT_SCHEMA`` of released rows; moves their cards' past on."""
        user, names = pd.factorize(rows["user"].to_numpy(zero_copy_only=False))
        order = np.lexsort((rows["tie"].to_numpy(), rows["unix_time"].to_numpy(), user))
        rows, user = rows.take(pa.array(order)), user[order]
        raw = rows["amt"].to_numpy(zero_copy_only=False).astype("float64")          # null: NaN
        amt = raw.astype("float32")
        valid = ~np.isnan(amt)
        value = np.where(valid, amt.astype("float64"), 0.0)
        t = rows["unix_time"].to_numpy()
        k = len(t)
        prior_n, prev_t, prior_cnt = (np.empty(k, np.int64) for _ in range(3))
        prior_sum, first = np.empty(k), np.zeros(k, bool)
        starts = np.flatnonzero(np.append(True, user[1:] != user[:-1]))
        ends = np.append(starts[1:], k)
        cards = pa.array(names[user[starts]], pa.string())
        held = self.past.get()
        past = _unpacked(bytes(held[0])) if held is not None else PAST.empty_table()
        at = pc.index_in(cards, past["user"].combine_chunks())
        known = at.is_valid().to_numpy(zero_copy_only=False)
        n, s, nn, last_t = (past[c].take(at).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for c in PAST.names[1:])
        sums = value.copy()
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):              # one card each
            if b - a > 1:
                np.cumsum(value[a:b], out=sums[a:b])
        size = ends - starts
        counts = np.cumsum(valid)
        before = np.repeat(counts[starts] - valid[starts], size)                  # valid amounts of the cards before
        prior_n[:] = np.repeat(n - starts, size) + np.arange(k)
        prior_sum[:] = np.repeat(s, size) + (sums - value)
        prior_cnt[:] = np.repeat(nn, size) + counts - before - valid
        prev_t[1:] = t[:-1]
        prev_t[starts], first[starts] = last_t, ~known
        moved = pa.table([cards, n + size, s + sums[ends - 1], nn + (counts - before)[ends - 1], t[ends - 1]], schema=PAST)
        kept = past.filter(pc.invert(pc.is_in(past["user"], cards)))
        self.past.update((_packed(pa.concat_tables([kept, moved]).combine_chunks()),))
        out = {"user": rows["user"].to_pandas(), "unix_time": t, "tie": rows["tie"].to_numpy(), "amt": amt, "amt_raw": raw}
        out |= {c: rows[c].to_pandas() for c in PASS}
        out |= {"_prior_n": prior_n, "_prev_t": pd.arrays.IntegerArray(prev_t, first), "_prior_sum": prior_sum, "_prior_cnt": prior_cnt}
        return pd.DataFrame(out)


def stream_state_features(stream: DataFrame, delay_seconds: int = 0, shards: int | None = None) -> DataFrame:
    """L1/L4: per-card causal state columns on a stream (same contract as ``causal_pass``).

    B5: a record without ``cc_num`` is keyed by its ``user_id``, else by 'unknown'. ``shards`` keys of state (default: two for
    each shuffle partition); a query must be restarted with the number it was begun with.
    """
    from ..session import ship_package
    spark = stream.sparkSession
    ship_package(spark)
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    shards = shards or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = stream.withColumn("user", card_key(stream)).withWatermark("event_time", f"{int(delay_seconds)} seconds")
    x = x.select(F.pmod(F.hash("user"), F.lit(shards)).alias("shard"), "event_time", *COLS)
    return x.groupBy("shard").transformWithStateInPandas(CausalState(), OUT_SCHEMA, "Append", "EventTime")


def finalize(df: DataFrame) -> DataFrame:
    """A stream sink read back as a table, without the end markers of a replay."""
    return df.where(F.col("user") != SENTINEL_CARD)
