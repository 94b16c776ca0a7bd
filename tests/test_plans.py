"""Physical-plan properties that matter at scale."""

from riskflow.operators.features import causal_features, with_user
from riskflow.operators.lookups import recent_transactions
from riskflow.sources import tx_events

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_one_exchange_on_card(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(causal_features(with_user(tx_events(spark, SF))))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert p.count("Exchange hashpartitioning(user") == 1
    assert "SinglePartition" not in p


def test_recent_k_uses_group_limit(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(recent_transactions(tx_events(spark, SF), 5))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in p


def test_scan_prunes_columns(spark):
    df = tx_events(spark, SF).select("cc_num", "unix_time")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "props" not in p.split("ReadSchema")[1].split("\n")[0] or "value" not in p
