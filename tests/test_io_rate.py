"""A1 reader, L5/L6 rate and alarm semantics, M6 histogram edges."""

import pytest

from riskflow.operators.report import histogram
from riskflow.sources.io import read_transactions
from riskflow.streaming.rate import alarm, alert_rate


def test_read_transactions(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("cc_num,unix_time,amt,lat,long,merch_lat,merch_long,category,gender,state,is_fraud,extra\n"
                 "1,10,5.0,0,0,0,0,c,F,CA,0,x\n1,11,6.0,0,0,0,0,c,F,CA,1,y\n")
    df = read_transactions(spark, [str(f), str(tmp_path / "missing.csv")])
    assert df.count() == 2 and "extra" not in df.columns and "tie" in df.columns
    with pytest.raises(FileNotFoundError):
        read_transactions(spark, [str(tmp_path / "none.csv")])


def test_rate_and_alarm(spark):
    # 30 s windows: periods 0, 60, 120 breach; 180 has no data; 240 breaches alone
    rows = [(t, flag) for t, flag in [(0, True), (10, False), (31, True), (60, True), (95, True), (130, True),
                                       (150, False), (245, True)]]
    df = spark.createDataFrame(rows, "unix_time long, flag boolean")
    r = {x["window_start"]: x for x in alert_rate(df).collect()}
    assert r[0]["total"] == 2 and r[0]["alerts"] == 1 and r[0]["rate"] == 0.5
    periods = sorted(x["period"] for x in alarm(alert_rate(df)).collect())
    assert periods == [120]


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4]], "v double")
    h = {r["bin"]: r["n"] for r in histogram(df, "v", 2).collect()}
    assert h == {0: 2, 1: 3}
