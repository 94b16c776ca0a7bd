"""First rows by rank, look-ahead pruning, merged co-moments, eigen checks, buckets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskflow.operators import moments
from riskflow.operators.causal import near_targets
from riskflow.operators.ordering import first_rows
from riskflow.operators.pca import eigen_check
from riskflow.operators.report import corr_matrix
from riskflow.operators.windows import seq_windows, split_windows
from riskflow.session import scratch_path
from riskflow.sources.io import write_bucketed


def test_first_rows_equal_the_sorted_head(spark):
    rng = random.Random(3)
    values = [None, 1.5, float("nan"), -2.0, float("inf"), 1.5, 7.25]
    rows = [(rng.choice(values), rng.choice([None, 1, 2, 3, 10**15, -(10**15)]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "v double, k long, tie long").repartition(5)
    want = [r["tie"] for r in df.orderBy("v", "k", "tie").collect()]
    for n in (-1, 0, 1, 57, 58, 199, 200, 350, 399, 400, 1000):
        got = first_rows(df, ["v", "k", "tie"], n)
        assert sorted(r["tie"] for r in got.collect()) == sorted(want[:max(n, 0)]), n
    plan = first_rows(df, ["v", "k", "tie"], 200)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan
    assert first_rows(df.limit(0), ["v", "k", "tie"], 5).count() == 0


def sequences(spark, rows=900, cards=12):
    rng = random.Random(4)
    data = [(f"c{rng.randrange(cards) if rng.random() < 0.6 else 0}", rng.randrange(5000), i, float(i), rng.choice([0, 0, 0, 1, 2])) for i in range(rows)]
    return spark.createDataFrame(data, "user string, unix_time long, tie long, x double, split int").repartition(4)


@pytest.mark.parametrize("hot", [dict(), dict(hot_rows=20, chunk_rows=15), dict(hot_rows=20, chunk_rows=3)])
def test_pruned_windows_equal_the_others(spark, hot):
    df = sequences(spark)
    for which, code in (("val", 1), ("test", 2)):
        want = seq_windows(df, ["x"], 7).where(F.col("split") == code).select("tie", "window")
        got = split_windows(df, which, ["x"], 7, **hot).select("tie", "window")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_pruning_keeps_little_and_adds_no_shuffle(spark):
    df = sequences(spark, 3000, 5).withColumn("split", F.when(F.col("unix_time") < 4500, 0).otherwise(1)).withColumn("_chunk", F.lit(0))
    w = Window.partitionBy("user", "_chunk").orderBy("unix_time", "tie")
    targets = df.where("split = 1").count()
    assert near_targets(df, w, F.col("split") == 1, 8).count() <= 2 * targets + 5 * 7
    plan = split_windows(df.drop("_chunk"), "val", ["x"], 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_co_moments_of_large_means_nulls_and_classes(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(2000, 3)) @ np.array([[1.0, 0.4, 0.0], [0.0, 1.0, -0.7], [0.0, 0.0, 1.0]])
    x = base + np.array([1e9, -1e9, 0.0])
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in r) + (int(i % 3 == 0), float("nan") if i % 5 == 0 else 2.0) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int, k double").repartition(7)
    got = {(r["f1"], r["f2"]): r["r"] for r in corr_matrix(df, ["a", "b", "c", "k"]).collect()}
    full = np.array([[np.nan if v is None else v for v in r[:3]] for r in rows]) - np.array([1e9, -1e9, 0.0])
    for i, a in enumerate("abc"):
        for j, b in enumerate("abc"):
            if j > i:
                both = ~np.isnan(full[:, i]) & ~np.isnan(full[:, j])
                assert abs(got[a, b] - np.corrcoef(full[both, i], full[both, j])[0, 1]) < 1e-6
    assert got["k", "k"] is None and got["a", "k"] is None and abs(got["c", "c"] - 1) < 1e-12
    by = moments.co_moments(df, ["a", "b", "c"], "y")
    assert sorted(by) == [0, 1]
    both = by[0].merged(by[1])
    whole = moments.co_moments(df, ["a", "b", "c"])[None]
    assert (both.n == whole.n).all() and np.allclose(both.co, whole.co, rtol=1e-6) and np.allclose(both.mean, whole.mean)
    assert moments.co_moments(df.limit(0), ["a"]) == {} and corr_matrix(df.limit(0), ["a"]).first()["r"] is None


def test_many_tasks_merge_in_groups(spark):
    df = spark.range(5000).select((F.col("id") + 1e8).alias("a"), (F.col("id") * -2).cast("double").alias("b")).repartition(150)
    assert abs(corr_matrix(df, ["a", "b"]).where("f1 <> f2").first()["r"] + 1) < 1e-12


def test_eigen_check_sees_wrong_vectors(spark, monkeypatch):
    from riskflow.operators import pca
    rng = np.random.default_rng(0)
    rows = [(*map(float, r), int(i % 3 == 0), int(i >= 200)) for i, r in enumerate(rng.normal(size=(300, 5)) @ np.diag([5.0, 3, 2, 1, 0.2]))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, y int, split int")
    good = eigen_check(df, list("abcde")).collect()
    assert len(good) == 3 and all(r["enough"] and r["least"] and r["projected"] and r["residual"] < 1e-9 and r["skew"] < 1e-9 for r in good)
    true = pca.eigenpairs
    monkeypatch.setattr(pca, "eigenpairs", lambda cov, v=pca.VARIANCE: (true(cov, v)[0], true(cov, v)[1][:, ::-1]))
    assert all(r["residual"] > 1e-3 for r in eigen_check(df, list("abcde")).collect())


def test_buckets_are_read_without_an_exchange(spark):
    df = sequences(spark)
    write_bucketed(df, "bucket_test", scratch_path(spark, "bucket-test"), 6)
    read = spark.table("bucket_test")
    wins = seq_windows(read, ["x"], 7)
    last = read.withColumn("r", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("unix_time"), F.desc("tie")))).where("r <= 3")
    for frame in (wins, last):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, wins.select("tie", "window").collect())) == sorted(map(str, seq_windows(df, ["x"], 7).select("tie", "window").collect()))
    spark.sql("DROP TABLE bucket_test")
