"""K1-K4: fallback table, three tiers, alert validation."""

from pyspark.sql import functions as F

from riskflow.operators import triage as K


def alerts(spark, scores):
    return spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "alert_id long, score double")


def test_fallback_table(spark):
    out = K.resolve(alerts(spark, [0.95, 0.6, 0.2])).orderBy("alert_id").collect()
    assert [r["decision"]["action"] for r in out] == ["block", "review", "allow"]
    assert all(r["decision"]["rationale"] == "fallback" for r in out)
    assert [r["decision"]["confidence"] for r in out] == [0.95, 0.6, 0.2]


def test_three_tiers(spark):
    a = alerts(spark, [0.95, 0.6, 0.2])
    t1 = spark.createDataFrame([(0, "allow", "looks fine", 0.7), (1, "review", "bad conf", 1.5)],
                               "alert_id long, action string, rationale string, confidence double")
    t2 = spark.createDataFrame([(1, "block", "extracted", None), (2, "nuke", "bad action", 0.1)],
                               "alert_id long, action string, rationale string, confidence double")
    out = {r["alert_id"]: r for r in K.resolve(a, structured=t1, extracted=t2).collect()}
    assert out[0]["decision"]["action"] == "allow" and out[0]["decision_source"] == "structured"
    assert out[1]["decision"]["action"] == "block" and out[1]["decision_source"] == "extracted"
    assert out[2]["decision"]["action"] == "allow" and out[2]["decision_source"] == "fallback"


def test_parse_alerts_quarantine(spark):
    vals = ['{"tx": {"cc_num": "1", "amt": 5.0, "category": "c", "state": "s", "unix_time": 10}, "prob": 0.7}',
            '{"tx": {"user_id": "9", "amt": 5.0, "category": "c", "state": "s", "unix_time": 10}, "prob": 1.7}',
            '{"tx": {"amt": 5.0, "state": "s", "unix_time": 10}, "prob": 0.1}',
            'not json']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "alert_id long, value string")
    out = {r["alert_id"]: r for r in K.parse_alerts(df).collect()}
    assert out[0]["valid"] and out[0]["card_id"] == "1"
    assert out[1]["error"] == "prob outside [0, 1]" and out[1]["card_id"] == "9"
    assert out[2]["error"] == "missing category" and out[2]["card_id"] == "unknown"
    assert not out[3]["valid"]
    text = K.parse_alerts(df).where("alert_id = 0").select(K.alert_text(K.parse_alerts(df))).first()[0]
    assert text == "Flagged transaction on card 1 (model fraud score 0.700).\nAmount: 5.0, category: c, state: s, unix_time: 10."
