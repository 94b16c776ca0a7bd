"""Stream replay (A6/A7, L1) equals the batch features; out-of-order rows within the delay too (L4)."""

from riskflow.operators.features import causal_features, with_user
from riskflow.session import scratch_path
from riskflow.sources import tx_events
from riskflow.streaming.jobs import run_stream
from riskflow.streaming.replay import write_replay
from riskflow.streaming.stateful import finalize

SF = "/root/testdata/sf0.001"
COLS = ["tie", "dt", "amt_roll_mean", "amt_count", "hour"]


def test_replay_equals_batch_with_late_rows(spark):
    from riskflow.plans.build import build_processed
    tx = tx_events(spark, SF)
    p = build_processed(tx, materialize=False)
    batch = causal_features(with_user(tx)).select(*COLS).orderBy("tie").collect()
    for late, file_rows in ((0, 100_000), (7, 100_000), (0, 60)):       # 60: many small files, so many micro-batches
        src = scratch_path(spark, "replay-test")
        info = write_replay(tx, src, files=4 if file_rows > 60 else None, late_every=late, file_rows=file_rows)
        assert info["files"] == (4 if file_rows > 60 else -(-tx.count() // 60))
        run = run_stream(spark, src, p, 0.5, delay_seconds=info["span"] + 1 if late else 0, metric_delay_seconds=info["span"] + 1)
        got = finalize(spark.read.parquet(run.features)).select(*COLS).orderBy("tie").collect()
        assert got == batch
        assert run.dropped_late == 0
        assert spark.read.parquet(run.metrics).agg({"total": "sum"}).first()[0] == tx.count()     # the last window too


def test_late_rows_are_counted(spark):
    from riskflow.plans.build import build_processed
    tx = tx_events(spark, SF)
    src = scratch_path(spark, "replay-test")
    write_replay(tx, src, files=8, late_every=7, late_by=5)
    run = run_stream(spark, src, build_processed(tx, materialize=False), 0.5)
    assert 0 < run.dropped_late == tx.count() - finalize(spark.read.parquet(run.features)).count()


def test_missing_card_is_keyed_by_user(spark):
    from pyspark.sql import functions as F
    from riskflow.streaming.stateful import stream_state_features
    from riskflow.streaming.replay import read_stream
    tx = tx_events(spark, SF).withColumn("user_id", F.concat(F.lit("u"), "cc_num")).withColumn("cc_num", F.when(F.col("tie") % 2 == 0, F.col("cc_num")))
    src = scratch_path(spark, "replay-test")
    write_replay(tx, src, files=2)
    q = (stream_state_features(read_stream(spark, src, 1)).writeStream.format("memory").queryName("b5").trigger(availableNow=True).start())
    q.awaitTermination()
    keys = {r["user"] for r in finalize(spark.table("b5")).select("user").distinct().collect()}
    assert {k[:1] == "u" for k in keys} == {True, False}


def test_alerts_are_written_while_the_stream_runs(spark):
    """Alerts of a feature batch are there before the batch after the next one is begun."""
    from datetime import datetime

    from pyspark.sql import functions as F

    from riskflow.plans.build import build_processed
    tx = tx_events(spark, SF)
    src = scratch_path(spark, "replay-test")
    info = write_replay(tx, src, files=5)
    run = run_stream(spark, src, build_processed(tx, materialize=False), 0.02, metric_delay_seconds=info["span"] + 1, pace_seconds=8.0, shards=8)
    starts = sorted(datetime.fromisoformat(b["start"].replace("Z", "+00:00")).timestamp() for b in run.batches if b["rows"])
    stamp = F.unix_millis("_metadata.file_modification_time") / 1000.0
    written = spark.read.parquet(run.features).select("tie", stamp.alias("feature_at"))
    alerts = spark.read.parquet(run.alerts).select(F.col("alert_id").alias("tie"), stamp.alias("alert_at"))
    rows = alerts.join(written, "tie").collect()
    assert len(rows) == alerts.count() > 50
    batches = set()
    for r in rows:
        batch = sum(s <= r["feature_at"] for s in starts) - 1
        batches.add(batch)
        if batch + 2 < len(starts):
            assert r["alert_at"] < starts[batch + 2]
    assert len(batches) >= 3


def test_state_of_hot_cards_ties_and_long_waits(spark):
    """A card with most rows, equal times, null amounts and rows that wait over several batches, in few and in many shards."""
    from pyspark.sql import functions as F

    from riskflow.operators.features import finish_features
    from riskflow.streaming.replay import read_stream
    from riskflow.streaming.stateful import stream_state_features
    tx = (tx_events(spark, SF).withColumn("cc_num", F.when(F.col("tie") % 3 == 0, F.lit("hot")).otherwise(F.col("cc_num")))
          .withColumn("unix_time", (F.col("unix_time") / 5000).cast("long") * 5000).withColumn("amt", F.when(F.col("tie") % 7 != 0, F.col("amt"))))
    want = causal_features(with_user(tx)).select(*COLS).orderBy("tie").collect()
    for shards, late in ((1, 0), (50, 4)):
        src = scratch_path(spark, "replay-test")
        info = write_replay(tx, src, files=6, late_every=late, late_by=2)
        feats = finish_features(stream_state_features(read_stream(spark, src, 1), (3 * info["span"] + 1) if late else 0, shards))
        name = f"state{shards}"
        (feats.writeStream.format("memory").queryName(name).option("checkpointLocation", scratch_path(spark, "ckpt")).trigger(availableNow=True).start()).awaitTermination()
        assert finalize(spark.table(name)).select(*COLS).orderBy("tie").collect() == want


def test_alarm_stream_equals_batch(spark):
    """Quiet and missing periods break a row of breaches; the stream sees several batches."""
    from pyspark.sql import functions as F

    from riskflow.streaming.rate import alarm, alarm_stream, alert_rate
    flags = {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 5: 1, 6: 1, 8: 1, 9: 1, 10: 1, 11: 1, 20: 1}       # period 7 and 12-19 have no points
    rows = [(60 * p + s, bool(f) and s != 7) for p, f in flags.items() for s in (0, 7, 29, 31, 59)]
    path = scratch_path(spark, "alarm-test")
    for i in range(4):
        part = [r for r in rows if r[0] // 400 == i] + ([(10_000, False), (20_000, False)][i - 2:i - 1] if i > 1 else [])
        spark.createDataFrame(part, "unix_time long, flag boolean").coalesce(1).write.mode("append").parquet(path)
    read = spark.readStream.schema("unix_time long, flag boolean").option("maxFilesPerTrigger", 1).parquet(path)
    found = alarm_stream(read.withColumn("event_time", F.timestamp_seconds("unix_time")), real=F.col("unix_time") < 5000)
    (found.writeStream.format("memory").queryName("alarms").option("checkpointLocation", scratch_path(spark, "ckpt")).trigger(availableNow=True).start()).awaitTermination()
    batch = alarm(alert_rate(spark.createDataFrame(rows, "unix_time long, flag boolean")))
    assert sorted(tuple(r) for r in spark.table("alarms").collect()) == sorted(tuple(r) for r in batch.collect())
    assert sorted(r["period"] for r in batch.collect()) == [120, 180, 600, 660]


def test_shards_start_at_their_ends_and_take_few_records(spark, tmp_path):
    import json

    from riskflow.streaming.shards import read_shards

    def add(shard, numbers, end="\n"):
        with open(tmp_path / "in" / shard, "a") as f:
            f.write("\n".join(json.dumps({"cc_num": shard, "unix_time": n, "tie": n, "amt": 1.5}) for n in numbers) + end)

    (tmp_path / "in").mkdir()
    add("a.json", range(50))
    add("_mark", range(9))

    def start():
        return (read_shards(spark, str(tmp_path / "in"), records=10).writeStream.format("parquet")
                .option("checkpointLocation", str(tmp_path / "ckpt")).start(str(tmp_path / "out")))

    q = start()
    q.processAllAvailable()                             # nothing: a new query starts at the ends
    add("a.json", range(50, 75))
    add("b.json", range(100, 117), end="")              # its last line has no end yet
    q.processAllAvailable()
    assert max(p.numInputRows for p in q.recentProgress) == 20
    q.stop()
    add("b.json", [], end="\n")
    add("b.json", range(117, 130))
    q = start()
    q.processAllAvailable()
    q.stop()
    got = [r["tie"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [*range(50, 75), *range(100, 130)]


def test_alert_batches_do_not_read_the_history_again(spark, tmp_path):
    """The lookups are made once; later batches leave the history alone and get what the batch operator gives."""
    from pyspark.sql import functions as F

    from riskflow.operators import triage as K
    from riskflow.streaming.jobs import alert_batch
    read = spark.sparkContext.accumulator(0)

    def counted(v):
        read.add(1)
        return v

    rows = [(f"c{i % 7}" if i % 11 else None, 1000 + i // 3, i, float(i % 13), "ab"[i % 2], "xyz"[i % 3] if i % 5 else None, int(i % 4 == 0)) for i in range(300)]
    tx = spark.createDataFrame(rows, "cc_num string, unix_time long, tie long, amt double, category string, state string, is_fraud int")
    watched = tx.withColumn("amt", F.udf(counted, "double").asNondeterministic()("amt"))
    found = K.lookups(watched)
    once = read.value
    assert once >= 300
    flagged = tx.where("tie % 2 = 0").selectExpr("*", "0.9D AS prob", "1.0D AS merch_lat", "2.0D AS merch_long")
    handle = alert_batch(str(tmp_path / "alerts"), str(tmp_path / "bad"), found)
    for b in range(3):
        handle(K.alert_payload(flagged.where(F.col("tie") % 6 == 2 * b)), b)
    assert read.value == once
    cols = ["alert_id", "card_id", *K.ENRICHED]
    got = spark.read.parquet(str(tmp_path / "alerts")).select(cols).orderBy("alert_id").collect()
    want = K.enrich(K.parse_alerts(K.alert_payload(flagged)).where("valid"), tx).select(cols).orderBy("alert_id").collect()
    assert got == want and len(got) > 100


def test_state_is_read_and_written_once_a_batch_whatever_the_cards():
    """A shard's cards lie in one packed value; what a second batch emits goes on from the first."""
    import pandas as pd
    import pyarrow as pa

    from riskflow.streaming.stateful import COLS, RUN, CausalState

    class Value:
        body, calls = None, 0

        def get(self):
            self.calls += 1
            return self.body

        def update(self, body):
            self.calls += 1
            self.body = body

    state = CausalState()
    state.past = Value()
    rows = [(f"c{i % 500}", 100 + i // 2, i, None if i % 7 == 0 else float(i % 9)) for i in range(3000)]

    def table(part):
        cols = {c: [r[j] for r in part] for j, c in enumerate(("user", "unix_time", "tie", "amt"))}
        return pa.table([pa.array(cols.get(c, [None] * len(part)), RUN.field(c).type) for c in COLS], schema=RUN)

    got = {}
    for part in (rows[:700], rows[700:710], rows[710:]):
        before = state.past.calls
        for r in state.with_past(table(part)).itertuples():
            got[r.tie] = tuple(r)[-4:]         # rows, last time, sum and count before
        assert state.past.calls - before == 2
    past: dict = {}
    for user, t, tie, amt in rows:
        n, s, nn, last = past.get(user, (0, 0.0, 0, None))
        seen = got[tie]
        assert (seen[0], None if pd.isna(seen[1]) else seen[1], *seen[2:]) == (n, last, s, nn)
        past[user] = (n + 1, s + (amt or 0.0), nn + (amt is not None), t)


def test_a_poll_of_many_shards_has_few_tasks(tmp_path):
    """Shards of a poll share tasks; each byte is in one part, and what the parts hold is every whole line once."""
    import json

    from riskflow.streaming.shards import ShardReader

    for i in range(300):
        with open(tmp_path / f"s{i:03d}", "w") as f:
            for n in range(i % 40):
                f.write(json.dumps({"cc_num": f"c{i}", "tie": i * 100 + n, "amt": 2, "state": "x" * (i * 3)}) + "\n" + ("\n" if n == 7 else ""))
            f.write('{"tie": 1')                        # a line without its end
    reader, start, got, polls = ShardReader(str(tmp_path), 10, "earliest", 8), {}, [], 0
    start = reader.initialOffset()
    while (end := reader.latestOffset()) != start:
        planned = reader.partitions(start, end)
        assert 1 <= len(planned) <= 8
        parts = [p for lines in planned for p in lines.parts]
        assert sorted(parts) == [(k, start[k], end[k]) for k in sorted(end) if end[k] > start[k]]
        new = [r["tie"] for lines in planned for b in reader.read(lines) for r in b.to_pylist()]
        assert len(new) <= 10 * len(parts)
        got, start, polls = got + new, end, polls + 1
    assert sorted(got) == [i * 100 + n for i in range(300) for n in range(i % 40)]
    assert polls == 4
