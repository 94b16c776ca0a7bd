"""Exact cutoffs, ties to the earlier split, no future leak, validation."""

import random

import pytest
from pyspark.sql import functions as F

from riskflow.operators.split import cutoffs, split_bounds, split_summary, time_split


def times(spark, ts):
    return spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(ts)], "tie long, unix_time long, is_fraud int")


def test_sizes(spark):
    out = time_split(times(spark, list(range(100))))
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {0: 70, 1: 10, 2: 20}


def test_ties_go_earlier(spark):
    c = cutoffs(times(spark, [0, 0, 0, 0, 0, 1, 2, 3, 4, 5]))
    assert (c.train_max_t, c.val_max_t) == (2, 3)


def test_no_leak_shuffled(spark):
    rnd = random.Random(0)
    ts = [rnd.randint(0, 500) for _ in range(1000)]
    rnd.shuffle(ts)
    b = {r["split"]: r for r in split_bounds(time_split(times(spark, ts))).collect()}
    assert b[0]["max_t"] < b[1]["min_t"] < b[2]["min_t"]
    assert all(r["ordered"] for r in b.values())


def test_summary_has_all_splits(spark):
    df = time_split(times(spark, list(range(10))), test_size=0.2, val_size=0.0)
    s = {r["split"]: r for r in split_summary(df).collect()}
    assert s[1]["rows"] == 0 and s[1]["fraud_rate"] == 0.0


def test_invalid(spark):
    with pytest.raises(ValueError):
        cutoffs(times(spark, [1, 2, 3]), test_size=0.6, val_size=0.5)
    with pytest.raises(ValueError):
        cutoffs(spark.createDataFrame([], "tie long, unix_time long, is_fraud int"))
