"""Schemas, column allow-lists and the ordered feature specification."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# The raw transaction columns used by the batch job and, without the label,
# by scoring / history lookups (A2).
USE_COLS = ("cc_num", "unix_time", "amt", "lat", "long", "merch_lat", "merch_long",
            "category", "gender", "state", "is_fraud")
SCORING_COLS = ("cc_num", "unix_time", "amt", "lat", "long", "merch_lat", "merch_long",
                "category", "gender", "state")

# Raw transaction schema (explicit, never inferred). ``tie`` is ours: a total order inside
# equal ``unix_time`` values.
RAW_TX = T.StructType([
    T.StructField("cc_num", T.StringType()),
    T.StructField("unix_time", T.LongType()),
    T.StructField("amt", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("long", T.DoubleType()),
    T.StructField("merch_lat", T.DoubleType()),
    T.StructField("merch_long", T.DoubleType()),
    T.StructField("category", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("is_fraud", T.IntegerType()),
    T.StructField("tie", T.LongType()),
])

# Split codes (fixed values).
TRAIN, VAL, TEST = 0, 1, 2
SPLIT_CODE = {"train": TRAIN, "val": VAL, "test": TEST}

# Default categorical columns, in code-block order (fixed values).
CATEGORICAL = ("category", "gender", "state")
USER_KEY_COLS = ("cc_num",)


@dataclass(frozen=True)
class FeatureSpec:
    """Toggles for the causal numeric features; emitted order is fixed."""

    amount_log: bool = True
    time_deltas: bool = True
    rolling_aggs: bool = True
    geo_distance: bool = True
    time_features: bool = True
    categorical: tuple[str, ...] = field(default=CATEGORICAL)

    def numeric(self) -> list[str]:
        cols = ["amt"]
        if self.amount_log:
            cols.append("amt_log")
        if self.time_deltas:
            cols.append("dt")
        if self.rolling_aggs:
            cols += ["amt_roll_mean", "amt_count"]
        if self.geo_distance:
            cols.append("geo_dist")
        if self.time_features:
            cols += ["hour", "dow"]
        return cols

    def codes(self) -> list[str]:
        return [f"{c}_code" for c in self.categorical]

    def all(self) -> list[str]:
        return self.numeric() + self.codes()


DEFAULT_SPEC = FeatureSpec()
SEQ_LEN = 32          # fixed value: default window length
TEST_SIZE = 0.2       # fixed value: most recent share -> test
VAL_SIZE = 0.1        # fixed value: share just before test -> val
REVIEW_THRESHOLD = 0.5
BLOCK_THRESHOLD = 0.9
