"""Padding, card isolation, split targets reaching back into train, pos_weight."""

from pyspark.sql import functions as F

from riskflow.operators.windows import pos_weight, seq_windows, split_windows


def frame(spark, xs, users, splits=None, ys=None):
    n = len(xs)
    splits = splits or [0] * n
    ys = ys or [0] * n
    return spark.createDataFrame([(str(u), i, i, float(x), s, y) for i, (x, u, s, y) in enumerate(zip(xs, users, splits, ys))],
                                 "user string, unix_time long, tie long, x double, split int, y int")


def wins(df):
    return [[v[0] for v in r["window"]] for r in df.orderBy("tie").collect()]


def test_windows_5(spark):
    df = frame(spark, [1, 2, 3, 4, 5], [0, 0, 0, 1, 1])
    expect = [[0, 0, 1], [0, 1, 2], [1, 2, 3], [0, 0, 4], [0, 4, 5]]
    assert wins(seq_windows(df, ["x"], 3)) == expect
    assert wins(seq_windows(df, ["x"], 3, hot_rows=1, chunk_rows=1)) == expect


def test_split_targets_reach_back(spark):
    df = frame(spark, [1, 2, 3, 4], [0, 0, 0, 0], splits=[0, 0, 1, 1], ys=[0, 0, 0, 1])
    v = split_windows(df, "val", ["x"], 3)
    assert wins(v) == [[1, 2, 3], [2, 3, 4]]
    assert pos_weight(v).first()["pos_weight"] == 1.0
    assert pos_weight(df.where("split = 0")).first()["pos_weight"] == 1.0  # no positive


def test_null_feature_keeps_its_step(spark):
    df = frame(spark, [1, 2, 3], [0, 0, 0]).withColumn("x", F.when(F.col("tie") == 1, None).otherwise(F.col("x")))
    assert wins(seq_windows(df, ["x"], 3))[2] == [1, None, 3]


def test_hot_chunk_carries_by_shuffle_join_match(spark):
    from riskflow.operators.causal import causal_pass
    df = frame(spark, list(range(1, 13)), [0] * 8 + [1] * 4).withColumn("v", F.array("x"))
    kw = dict(key="user", order=["unix_time", "tie"], value="x", vec="v", seq_len=3)
    plain = causal_pass(df, **kw).orderBy("tie").collect()
    bcast = causal_pass(df, hot_rows=2, chunk_rows=3, **kw).orderBy("tie").collect()
    joined = causal_pass(df, hot_rows=2, chunk_rows=3, carry_broadcast_max=0, **kw)
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString().split("Window")[0]
    assert plain == bcast == joined.orderBy("tie").collect()


def test_hot_card_burst_at_one_timestamp_is_split_evenly(spark):
    from riskflow.operators.causal import _chunked, causal_pass
    rows = [("hot", 100, i, float(i % 7)) for i in range(300)]            # one timestamp, 300 rows
    rows += [("hot", 100 + i, 300 + i, 1.0) for i in range(1, 61)]          # then a trickle
    rows += [("cold", i, 1000 + i, 2.0) for i in range(5)]
    df = spark.createDataFrame(rows, "user string, unix_time long, tie long, x double").withColumn("v", F.array("x"))
    x, n_chunks = _chunked(df, "user", ["unix_time", "tie"], hot_rows=50, chunk_rows=40)
    sizes = [r["n"] for r in x.where("_chunk > 0").groupBy("_chunk").count().withColumnRenamed("count", "n").collect()]
    assert n_chunks == 9 and sum(sizes) == 360 and max(sizes) <= 80      # equal-width time ranges would put 300 in one
    kw = dict(key="user", order=["unix_time", "tie"], value="x", vec="v", seq_len=4)
    plain = causal_pass(df, **kw).orderBy("tie").collect()
    hot = causal_pass(df, hot_rows=50, chunk_rows=40, **kw).orderBy("tie").collect()
    assert plain == hot
