"""J1-J8 on the literal store/tool frames."""

from riskflow.operators import lookups as J

TX = "cc_num string, unix_time long, tie long, amt double, category string, state string, is_fraud int, " \
     "lat double, long double, merch_lat double, merch_long double, gender string"


def tools(spark):
    rows = [("111", 1, 0, 10.0, "grocery", "CA", 1), ("111", 2, 1, 20.0, "shopping", "NY", 0),
            ("111", 3, 2, 30.0, "grocery", "CA", 0), ("222", 4, 3, 5.0, "gas", "TX", 0)]
    return spark.createDataFrame([r + (0.0, 0.0, 0.0, 0.0, "F") for r in rows], TX)


def test_history_order_and_no_label(spark):
    rows = [("111", 2, 0), ("111", 1, 1), ("222", 5, 2), ("111", 3, 3)]
    df = spark.createDataFrame([r + (1.0, "c", "s", 0, 0.0, 0.0, 0.0, 0.0, "F") for r in rows], TX)
    h = J.raw_history(df, spark.createDataFrame([("111",), ("999",)], "card_id string"))
    assert "is_fraud" not in h.columns
    assert [r["unix_time"] for r in h.orderBy("position").collect()] == [1, 2, 3]
    assert [r["card_id"] for r in J.card_ids(df, 0).collect()] == ["111", "222"]


def test_profile_recent_rates(spark):
    df = tools(spark)
    p = {r["card_id"]: r for r in J.card_profile(df).collect()}
    assert p["111"]["tx_count"] == 3 and p["111"]["home_state"] == "CA"
    assert p["111"]["top_categories"] == ["grocery", "shopping"] and p["111"]["median_amt"] == 20.0
    req = spark.createDataFrame([("111",), ("nope",)], "card_id string")
    unknown = {r["card_id"]: r for r in J.profile_requests(req, J.card_profile(df)).collect()}["nope"]
    assert (unknown["tx_count"], unknown["median_amt"], unknown["top_categories"], unknown["home_state"]) == (0, 0.0, [], None)
    rec = [r["unix_time"] for r in J.recent_transactions(df, 2).where("card_id = '111'").orderBy("k").collect()]
    assert rec == [2, 3]
    assert J.recent_transactions(df, 0).count() == 0
    rates = J.segment_rates(df)
    seg = spark.createDataFrame([("grocery", "CA"), ("gas", "ZZ")], "category string, state string")
    got = {(r["category"], r["state"]): r["fraud_rate"] for r in J.segment_lookup(seg, rates).collect()}
    assert got == {("grocery", "CA"): 0.5, ("gas", "ZZ"): 0.0}


def test_argument_errors(spark):
    req = spark.createDataFrame([(" ", 5, "a", "b"), ("1", 0, "a", "b"), ("1", 5, "", "b"), ("1", 5, "a", "b")],
                                "card_id string, k long, category string, state string")
    errs = [r["error"] for r in J.validate_requests(req).collect()]
    assert errs[0].startswith("card_id") and errs[1].startswith("k must") and errs[2].startswith("category")
    assert errs[3] is None


def test_sample_test_is_repeatable(spark):
    df = tools(spark).withColumn("split", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(2))
    a = [r["tie"] for r in J.sample_test(df, n=2, seed=7).collect()]
    b = [r["tie"] for r in J.sample_test(df, n=2, seed=7).collect()]
    assert a == b and len(a) == 2
    import pytest
    with pytest.raises(ValueError):
        J.sample_test(df.where("split = 0"))


def test_group_median_hot_keys_by_bisection(spark):
    import random

    import numpy as np

    from riskflow.operators.lookups import group_median
    rnd = random.Random(7)
    rows = [("hot", round(rnd.uniform(-50, 500), 3)) for _ in range(900)] + [("hot", 42.0)] * 300
    rows += [(f"c{i}", float(rnd.randint(0, 30))) for i in range(40) for _ in range(rnd.randint(1, 9))]
    rows += [("nulls", None), ("nulls", 5.0), ("nulls", 7.0)]
    df = spark.createDataFrame(rows, "key string, v double")
    expect = {}
    for k, v in rows:
        if v is not None:
            expect.setdefault(k, []).append(v)
    for hot_distinct in (0, 5, 10**9):   # every key / mixed / none through the bisection
        got = {r["key"]: r["median"] for r in group_median(df, "key", "v", hot_distinct=hot_distinct).collect()}
        assert got.keys() == expect.keys()
        for k, vs in expect.items():
            assert got[k] == float(np.median(vs)), (hot_distinct, k)


def test_profile_of_hot_cards_equals_the_others(spark):
    """Cards whose amounts leave the window, nulls, NaN, names with commas and equal counts."""
    import random

    import numpy as np
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "b", "c", None]), t, t, rnd.choice([None, float("nan"), rnd.randint(0, 40) / 4, rnd.randint(0, 40) / 4]),
             rnd.choice(["x", "y,z", "z", "w", None]), rnd.choice(["S", "T", None])) for t in range(600)]
    df = spark.createDataFrame([r + (0, 0.0, 0.0, 0.0, 0.0, "F") for r in rows], TX).repartition(4)
    plain = sorted(map(str, J.card_profile(df).collect()))
    for most in (0, 8, 39):
        assert sorted(map(str, J.card_profile(df, hot_distinct=most).collect())) == plain
    for r in J.card_profile(df).collect():
        own = [x for x in rows if x[0] == r["card_id"]]
        amounts = [x[3] for x in own if x[3] is not None and x[3] == x[3]]
        counts = lambda i: sorted({x[i] for x in own if x[i]}, key=lambda v: (-sum(x[i] == v for x in own), v))  # noqa: E731, B023
        assert r["tx_count"] == len(own) and abs(r["median_amt"] - np.median(amounts)) < 0.0051 and abs(r["avg_amt"] - np.mean(amounts)) < 0.0051
        assert r["top_categories"] == counts(4)[:3] and r["home_state"] == counts(5)[0]


def test_requests_of_very_different_sizes(spark):
    rows = [("111", t, t, float(t), "grocery", "CA", 0) for t in range(300)] + [("222", t, t, 1.0, "gas", "TX", 0) for t in range(9)]
    df = spark.createDataFrame([r + (0.0, 0.0, 0.0, 0.0, "F") for r in rows], TX).repartition(3)
    ask = [(1, "111", 290, "grocery", "CA"), (2, "111", 3, "grocery", "CA"), (3, "222", 1, "gas", "TX"), (4, "222", J.MAX_RECENT + 1, "gas", "TX"), (5, "999", 17, "gas", "TX")]
    req = spark.createDataFrame(ask, "id long, card_id string, k long, category string, state string")
    got = {r["id"]: r for r in J.answer_requests(req, df).collect()}
    assert [x["unix_time"] for x in got[1]["recent"]] == list(range(10, 300)) and [x["k"] for x in got[1]["recent"]] == list(range(1, 291))
    assert [(x["k"], x["unix_time"]) for x in got[2]["recent"]] == [(1, 297), (2, 298), (3, 299)]
    assert [(x["k"], x["unix_time"], x["category"], x["state"]) for x in got[3]["recent"]] == [(1, 8, "gas", "TX")]
    assert got[4]["error"] == "k must be at most 10000." and got[4]["recent"] is None and got[5]["recent"] == [] and got[5]["tx_count"] == 0
