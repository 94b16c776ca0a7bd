"""C1-C9 on the literal 5-row frame, per-card reset, toggles, and the hot-card path."""

import math

import pytest
from pyspark.sql import functions as F

from riskflow.operators.features import causal_features, with_user
from riskflow.schema import FeatureSpec

ROWS = [  # user, t, amt, merchant lat/long
    ("A", 100, 10.0, 3.0, 4.0), ("A", 160, 20.0, 0.0, 0.0), ("A", 220, 30.0, 0.0, 0.0),
    ("B", 50, 5.0, 0.0, 0.0), ("B", 86450, 7.0, 0.0, 0.0),
]


def frame(spark):
    return spark.createDataFrame(
        [(u, t, i, a, 0.0, 0.0, ml, mlo) for i, (u, t, a, ml, mlo) in enumerate(ROWS)],
        "cc_num string, unix_time long, tie long, amt double, lat double, long double, merch_lat double, merch_long double")


def rows(df):
    return {r["tie"]: r for r in df.collect()}


def test_values(spark):
    out = rows(causal_features(with_user(frame(spark))))
    assert [out[i]["amt_roll_mean"] for i in range(5)] == [0, 10, 15, 0, 5]
    assert [out[i]["amt_count"] for i in range(5)] == [0, 1, 2, 0, 1]
    assert [out[i]["dt"] for i in range(5)] == [0, 60, 60, 0, 86400]
    assert out[0]["geo_dist"] == pytest.approx(5.0)
    assert out[0]["amt_log"] == pytest.approx(math.log1p(10.0), rel=1e-6)
    assert out[4]["hour"] == 0.0 and out[3]["hour"] == 0.0
    assert out[0]["dow"] == 3.0  # 1970-01-01 is a Thursday (Monday = 0)


def test_order_and_toggles(spark):
    spec = FeatureSpec(rolling_aggs=False, time_features=False)
    assert spec.numeric() == ["amt", "amt_log", "dt", "geo_dist"]
    out = causal_features(with_user(frame(spark)), spec)
    assert "amt_roll_mean" not in out.columns and "hour" not in out.columns
    assert FeatureSpec().all() == ["amt", "amt_log", "dt", "amt_roll_mean", "amt_count", "geo_dist", "hour", "dow",
                                   "category_code", "gender_code", "state_code"]


def test_nan_amount_is_skipped_in_mean(spark):
    df = spark.createDataFrame([("A", 1, 0, 2.0), ("A", 2, 1, None), ("A", 3, 2, 4.0), ("A", 4, 3, 1.0)],
                               "cc_num string, unix_time long, tie long, amt double")
    df = df.withColumn("lat", F.lit(0.0)).withColumn("long", F.lit(0.0)).withColumn("merch_lat", F.lit(0.0)).withColumn("merch_long", F.lit(0.0))
    out = rows(causal_features(with_user(df)))
    assert [out[i]["amt_roll_mean"] for i in range(4)] == [0.0, 2.0, 2.0, 3.0]
    assert [out[i]["amt_count"] for i in range(4)] == [0, 1, 2, 3]


def test_hot_card_chunks_equal_plain_window(spark):
    from riskflow.sources import tx_events
    raw = with_user(tx_events(spark, "/root/testdata/sf0.001"))
    cols = ["tie", "dt", "amt_roll_mean", "amt_count"]
    plain = causal_features(raw).select(*cols).orderBy("tie").collect()
    hot = causal_features(raw, hot_rows=10, chunk_rows=4).select(*cols).orderBy("tie").collect()
    assert plain == hot


def test_future_rows_do_not_change_past_features(spark):
    base = frame(spark)
    more = base.unionByName(spark.createDataFrame([("A", 999, 9, 1000.0, 0.0, 0.0, 0.0, 0.0)], base.schema))
    a = rows(causal_features(with_user(base)))
    b = rows(causal_features(with_user(more)))
    for i in range(5):
        assert a[i] == b[i]
