"""Distributed order statistics, running totals and dense ids against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.operators.ordering import dense_index, exact_kth, exact_quantiles, running_totals


def test_exact_kth_with_hot_value(spark):
    rnd = random.Random(1)
    vals = [rnd.randint(-10**9, 10**12) for _ in range(3000)] + [42] * 1500   # one value holds a third
    df = spark.createDataFrame([(v,) for v in vals], "t long")
    s = sorted(vals)
    ks = [1, 1000, 2200, 3001, 4500]
    n, got = exact_kth(df, "t", ks)
    assert n == 4500 and got == [s[k - 1] for k in ks]


@pytest.mark.parametrize("literal_groups", [64, 0])   # literal targets / table-driven group_kth
def test_exact_quantiles_grouped_doubles(spark, monkeypatch, literal_groups):
    import riskflow.operators.ordering as O
    monkeypatch.setattr(O, "LITERAL_GROUPS_MAX", literal_groups)
    rnd = random.Random(2)
    rows = [(g, rnd.gauss(0, 1) * 100) for g in (0, 1) for _ in range(501 + g)]
    df = spark.createDataFrame(rows, "g long, v double")
    q = {r["g"]: r for r in exact_quantiles(df, "v", [0.25, 0.5, 0.99], by="g").collect()}
    for g in (0, 1):
        xs = [v for gg, v in rows if gg == g]
        assert q[g]["n"] == len(xs)
        assert q[g]["q_0"] == pytest.approx(np.percentile(xs, 25))
        assert q[g]["q_1"] == pytest.approx(np.percentile(xs, 50))
        assert q[g]["q_2"] == pytest.approx(np.percentile(xs, 99))


def test_running_totals_buckets_and_struct_order(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.randint(0, 50), rnd.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k long, w double").withColumn("key", F.struct("k", "id"))
    out = running_totals(df, "key", ["w"], rows_per_bucket=37).collect()
    got = {r["id"]: r["cum_w"] for r in out}
    srt = sorted(rows, key=lambda r: (r[1], r[0]))
    acc = 0.0
    for i, k, w in srt:
        acc += w
        assert got[i] == pytest.approx(acc)
    desc = running_totals(df.drop("key"), "id", ["k"], descending=True, rows_per_bucket=50).collect()
    tot = {r["id"]: r["cum_k"] for r in desc}
    assert tot[399] == rows[399][1] and tot[0] == sum(r[1] for r in rows)


def test_dense_index(spark):
    keys = ["b", "a", "c", "a", "é", "Z", "b"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r["key"]: r["idx"] for r in dense_index(df, "key").collect()}
    assert got == {k: i for i, k in enumerate(sorted(set(keys), key=lambda s: s.encode()))}


def test_group_kth_every_rank_of_many_keys(spark):
    from riskflow.operators.ordering import group_kth
    rnd = random.Random(11)
    rows = [(f"k{g}", rnd.choice([rnd.randint(-10**12, 10**12), 7, 7, 7])) for g in range(30) for _ in range(rnd.randint(1, 25))]
    rows += [("one", 5), ("flat", 3), ("flat", 3), ("flat", 3), ("nulls", None), ("nulls", 9)]
    df = spark.createDataFrame(rows, "key string, v long")
    vals = {}
    for k, v in rows:
        if v is not None:
            vals.setdefault(k, []).append(v)
    ranks = spark.createDataFrame([(k, i) for k, vs in vals.items() for i in range(1, len(vs) + 1)], "key string, k long")
    got = {(r["key"], r["k"]): r["kth"] for r in group_kth(df, "key", "v", ranks, buckets=16).collect()}
    expect = {(k, i + 1): x for k, vs in vals.items() for i, x in enumerate(sorted(vs))}
    assert got == expect
