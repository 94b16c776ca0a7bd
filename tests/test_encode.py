"""Train-only codes (NA gets a code when train has nulls), unseen -> 0, scaler rules."""

import pytest
from pyspark.sql import functions as F

from riskflow.operators.encode import apply_categories, collect_maps, collect_scaler, fit_categories, fit_scaler


def test_codes_train_only(spark):
    df = spark.createDataFrame([("b", 0), (None, 0), ("a", 0), ("c", 1), (None, 2)], "category string, split int")
    m = collect_maps(fit_categories(df, ["category"]))
    assert m == {"category": {"NA": 1, "a": 2, "b": 3}}
    out = [r["category_code"] for r in apply_categories(df, m).collect()]
    assert out == [3, 1, 2, 0, 1]


def test_null_only_in_val_is_unseen(spark):
    df = spark.createDataFrame([("a", 0), (None, 1)], "category string, split int")
    m = collect_maps(fit_categories(df, ["category"]))
    assert [r["category_code"] for r in apply_categories(df, m).collect()] == [1, 0]


def test_scaler_population_std_and_zero_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0), (3.0, 5.0, 0), (100.0, 7.0, 1)], "x double, z double, split int")
    s = collect_scaler(fit_scaler(df, ["x", "z"]))
    assert s["x"] == (pytest.approx(2.0), pytest.approx(1.0))
    assert s["z"] == (pytest.approx(5.0), 1.0)


def test_corrupting_non_train_rows_keeps_fit(spark):
    df = spark.createDataFrame([(float(i), "c%d" % (i % 3), 0 if i < 7 else 2) for i in range(10)],
                               "x double, category string, split int")
    bad = df.withColumn("x", F.when(F.col("split") == 2, F.lit(1e9)).otherwise(F.col("x"))) \
            .withColumn("category", F.when(F.col("split") == 2, F.lit("zzz")).otherwise(F.col("category")))
    assert collect_scaler(fit_scaler(df, ["x"])) == collect_scaler(fit_scaler(bad, ["x"]))
    assert collect_maps(fit_categories(df, ["category"])) == collect_maps(fit_categories(bad, ["category"]))


def test_large_maps_are_joined_not_inlined(spark, monkeypatch):
    import riskflow.operators.encode as E
    df = spark.createDataFrame([("b", "x", 0), (None, "y", 0), ("a", "x", 0), ("c", "z", 1), (None, None, 2)],
                               "category string, state string, split int")
    cat_map = fit_categories(df, ["category", "state"])
    inline = apply_categories(df, collect_maps(cat_map), ["category", "state"]).collect()
    monkeypatch.setattr(E, "LITERAL_MAP_MAX", 2)        # category (3 codes) goes by join, state (2) inline
    maps = collect_maps(cat_map)
    assert maps["category"] is None and maps["state"] == {"x": 1, "y": 2}
    with pytest.raises(ValueError):
        apply_categories(df, maps, ["category", "state"])
    joined = apply_categories(df, maps, ["category", "state"], cat_map)
    assert joined.columns == ["category", "state", "split", "category_code", "state_code"]
    key = lambda r: (r["split"], r["category"] or "", r["state"] or "")
    assert sorted(joined.collect(), key=key) == sorted(inline, key=key)
