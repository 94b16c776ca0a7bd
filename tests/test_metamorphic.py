"""Metamorphic checks: how the input is partitioned or ordered never changes a result."""

import pytest
from pyspark.sql import functions as F

from riskflow.operators.features import causal_features, with_user
from riskflow.operators.ordering import running_totals
from riskflow.plans.build import build_processed
from riskflow.schema import DEFAULT_SPEC
from riskflow.sources import tx_events

SF = "/root/testdata/sf0.001"


def shuffled(df):
    return df.repartition(7).orderBy(F.rand(3)).repartition(5)


def test_features_independent_of_input_order(spark):
    tx = tx_events(spark, SF)
    cols = ["tie", *DEFAULT_SPEC.numeric()]
    a = causal_features(with_user(tx)).select(*cols).orderBy("tie").collect()
    b = causal_features(with_user(shuffled(tx))).select(*cols).orderBy("tie").collect()
    assert a == b


def test_fit_independent_of_input_order(spark):
    tx = tx_events(spark, SF)
    p1 = build_processed(tx, materialize=False)
    p2 = build_processed(shuffled(tx), materialize=False)
    assert p1.cut == p2.cut
    assert p1.maps == p2.maps
    assert p1.stats.keys() == p2.stats.keys()
    for f, (m, s) in p1.stats.items():
        assert p2.stats[f] == pytest.approx((m, s), rel=1e-9, abs=1e-12)


def test_running_totals_window_is_per_range(spark):
    df = spark.range(500).withColumn("one", F.lit(1))
    out = running_totals(df, "id", ["one"], rows_per_bucket=50)
    p = out._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in p.splitlines() if "Window [" in line]
    # the running sum over the rows is partitioned by the range index (", [_bucket#n], [order]");
    # the only other window runs over the per-range totals, one row per range
    over_rows = [w for w in windows if "AS _loc_one" in w]
    assert len(over_rows) == 1 and "], [_bucket#" in over_rows[0]
    assert len(windows) == 2 and any("AS _off_one" in w for w in windows)
    assert sorted(r["cum_one"] for r in out.collect()) == list(range(1, 501))
