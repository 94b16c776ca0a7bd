"""Values and layouts the test tables do not hold: NaN and infinities, huge spans, null and hot keys, tiny file splits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.operators import ordering as R
from riskflow.operators.causal import causal_pass
from riskflow.operators.features import causal_features
from riskflow.operators.lookups import card_profile, group_median
from riskflow.operators.report import boxplot, describe_counts, histogram
from riskflow.operators.triage import plain_decimal, resolve
from riskflow.session import path_exists, remove_path, scratch_path
from riskflow.sources.io import load_processed, read_transactions, write_processed

NAN, INF = float("nan"), float("inf")
SETS = {
    "nan": [1.0, 2.0, NAN, 3.0, None],
    "infinite": [-INF, -INF, 1.0, 5.0, INF, NAN, 2.0],
    "equal": [7.0] * 9,
    "huge": [1.7e308, -1.7e308, 0.0, 5e-324, 1e-300, -1e-300, 3.0],
    "skewed": [2.0 ** k for k in range(-1000, 1000, 250)],
    "only nan": [NAN, None],
}


@pytest.mark.parametrize("name", sorted(SETS))
def test_order_statistics_end(spark, name):
    values = SETS[name]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = sorted(v for v in values if v is not None and not math.isnan(v))
    n, got = R.exact_kth(df, "v", lambda n: range(1, n + 1))
    assert n == len(want) and got == want
    keyed = df.withColumn("k", F.lit("a"))
    ranks = spark.createDataFrame([("a", k) for k in range(1, len(want) + 1)], "k string, r long").select("k", F.col("r"))
    kth = R.group_kth(keyed.withColumnRenamed("k", "key"), "key", "v", ranks.select(F.col("k").alias("key"), F.col("r").alias("k")), buckets=16)
    assert [r["kth"] for r in kth.orderBy("k").collect()] == want


def test_integers_near_the_limits(spark):
    values = [-(2 ** 63), 2 ** 63 - 1, 2 ** 62, 2 ** 62 + 1, 2 ** 62 + 2, 0, -1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert R.exact_kth(df, "v", lambda n: range(1, n + 1))[1] == sorted(values)


def test_quantiles_of_a_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", NAN), ("b", None)], "g string, v double")
    out = {r["g"]: (r["q_0"], r["n"]) for r in R.exact_quantiles(df, "v", [0.5], "g").collect()}
    assert out == {None: (2.0, 2), "a": (5.0, 1)}
    box = {r["g"]: r["median"] for r in boxplot(df, "v", "g").collect()}
    assert box == {None: 2.0, "a": 5.0}
    bins = histogram(df.where("NOT isnan(v)"), "v", 2, "g").groupBy("g").agg(F.sum("n").alias("n"))
    assert {r["g"]: r["n"] for r in bins.collect()} == {None: 2, "a": 1}


def test_global_positions_over_many_ranges(spark):
    keys = random.Random(1).sample(range(10_000), 500)
    out = R.global_positions(spark.createDataFrame([(k,) for k in keys], "k long").repartition(7), ["k"], "at", rows_per_range=20)
    assert {r["k"]: r["at"] for r in out.collect()} == {k: i for i, k in enumerate(sorted(keys))}


def test_nan_amounts_are_skipped(spark):
    rows = [("a", t, t, v) for t, v in enumerate([2.0, NAN, 4.0, 1.0, None, 8.0])]
    df = spark.createDataFrame(rows, "user string, unix_time long, tie long, amt double").withColumns(
        {c: F.lit(0.0) for c in ("lat", "long", "merch_lat", "merch_long")})
    got = [r["amt_roll_mean"] for r in causal_features(df).orderBy("tie").collect()]
    assert got == pytest.approx([0, 2, 2, 3, 7 / 3, 7 / 3])


def test_hot_null_key_is_cut_into_chunks(spark):
    rows = [(None if i % 10 else "a", i, i, float(i % 7)) for i in range(2000)]
    df = spark.createDataFrame(rows, "card string, unix_time long, tie long, v double").repartition(4)
    for limit in (10_000, 0):                                   # carries by broadcast and by join
        out = causal_pass(df, "card", ("unix_time", "tie"), value="v", hot_rows=300, chunk_rows=100, carry_broadcast_max=limit)
        by = {}
        for r in out.orderBy("tie").collect():
            seen = by.setdefault(r["card"], [])
            assert (r["_prior_n"], r["_prior_sum"]) == (len(seen), pytest.approx(sum(seen)))
            seen.append(r["v"])
    chunks = df.repartitionByRange(18, "card", "unix_time", "tie").groupBy(F.spark_partition_id().alias("p")).count()
    assert chunks.agg(F.max("count")).first()[0] <= 2 * 2000 / 18


def test_profile_ignores_null_categories_and_keeps_null_amounts(spark):
    rows = [("1", 1.0, None), ("1", 2.0, None), ("1", 3.0, None), ("1", 1.0, "a"), ("1", 1.0, "a"), ("1", 1.0, "b"), ("1", 1.0, "c"), ("2", None, "x"), ("3", NAN, "y")]
    tx = spark.createDataFrame(rows, "cc_num string, amt double, category string").withColumn("state", F.lit("s"))
    out = {r["card_id"]: r for r in card_profile(tx).collect()}
    assert out["1"]["top_categories"] == ["a", "b", "c"] and out["2"]["tx_count"] == 1 and out["2"]["median_amt"] is None
    assert group_median(tx, "cc_num", "amt").count() == 1


def test_describe_counts_is_one_pass(spark):
    sizes = [1, 1, 2, 5, 9, 9, 30]
    tx = spark.createDataFrame([(str(i),) for i, n in enumerate(sizes) for _ in range(n)], "cc_num string")
    r = describe_counts(tx).first()
    assert (r["count"], r["min"], r["max"]) == (7, 1.0, 30.0)
    assert (r["mean"], r["std"]) == (pytest.approx(np.mean(sizes)), pytest.approx(np.std(sizes, ddof=1)))
    assert [r[c] for c in ("p25", "p50", "p75")] == pytest.approx(list(np.quantile(sizes, [0.25, 0.5, 0.75])))


def test_amount_text_is_plain(spark):
    df = spark.createDataFrame([(v,) for v in (1e7, 12345678.9, 5.0, 0.25, -3.5, 100.0)], "v double")
    assert [r[0] for r in df.select(plain_decimal(F.col("v"))).collect()] == ["10000000.0", "12345678.9", "5.0", "0.25", "-3.5", "100.0"]


def test_invalid_duplicate_does_not_hide_a_decision(spark):
    a = spark.createDataFrame([(1, 0.2)], "alert_id long, score double")
    rows = [(1, "explode", "bad", 0.5), (1, "review", "good", 0.5), (1, "block", "good", 0.5)]
    for order in (rows, rows[::-1]):
        t = spark.createDataFrame(order, "alert_id long, action string, rationale string, confidence double").coalesce(1)
        r = resolve(a, structured=t).first()
        assert (r["decision"]["action"], r["decision_source"]) == ("block", "structured")


def test_csv_ties_with_tiny_splits(spark):
    base = scratch_path(spark, "csv-test")
    tx = spark.range(4000).select(F.col("id").cast("string").alias("cc_num"), (F.col("id") % 7).alias("unix_time"), F.lit(1.5).alias("amt"))
    tx.coalesce(1).write.option("header", True).csv(f"{base}/a")
    tx.coalesce(1).write.option("header", True).csv(f"{base}/b c")
    orders = []
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "700", "3k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = read_transactions(spark, [f"{base}/b c", f"{base}/none", f"{base}/a"])
            rows = df.select("cc_num", "tie").collect()
            assert len({r["tie"] for r in rows}) == len(rows) == 8000
            orders.append([r["cc_num"] for r in sorted(rows, key=lambda r: r["tie"])])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert orders[0] == orders[1] == orders[2] == [str(i) for i in range(4000)] * 2
    with pytest.raises(FileNotFoundError):
        read_transactions(spark, [f"{base}/none"])
    assert path_exists(spark, base)
    remove_path(spark, base)
    assert not path_exists(spark, base)


def test_processed_table_spreads_a_hot_card_and_checks_types(spark):
    path = scratch_path(spark, "processed-test")
    table = spark.range(4000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("user"), F.col("id").alias("unix_time"), F.col("id").alias("tie"))
    write_processed(table, path)
    assert load_processed(spark, path, table.schema).count() == 4000
    wrong = table.select("user", F.col("unix_time").cast("int").alias("unix_time")).schema
    with pytest.raises(ValueError, match="other types"):
        load_processed(spark, path, wrong)
