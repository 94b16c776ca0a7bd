"""Causal numeric features (C1-C9): each row sees only its own card's earlier rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import user_key
from ..functions.timecols import dow_monday0, hour_utc
from ..schema import DEFAULT_SPEC, USER_KEY_COLS, FeatureSpec
from .causal import CHUNK_ROWS, HOT_ROWS, causal_pass

ORDER = ("unix_time", "tie")


def with_user(df: DataFrame, key_cols: Sequence[str] = USER_KEY_COLS) -> DataFrame:
    """B1: add the string ``user`` key."""
    return df.withColumn("user", user_key(df, key_cols))


def causal_features(df: DataFrame, spec: FeatureSpec = DEFAULT_SPEC, key: str = "user",
                    order: Sequence[str] = ORDER, hot_rows: int = HOT_ROWS,
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """C1-C8 in one windowed pass. Adds the enabled features of ``spec`` as FLOAT columns.

    ``amt`` is cast to FLOAT first (C1); aggregation runs in DOUBLE and is cast back. A NaN amount
    counts as missing.
    """
    t = order[0]
    amt = F.col("amt").cast("float")
    x = df.withColumn("amt", F.when(~F.isnan(amt), amt))
    if spec.time_deltas or spec.rolling_aggs:
        x = causal_pass(x, key, order, t=t, value="amt" if spec.rolling_aggs else None,
                        hot_rows=hot_rows, chunk_rows=chunk_rows)
    return finish_features(x, spec, t)


def finish_features(x: DataFrame, spec: FeatureSpec = DEFAULT_SPEC, t: str = "unix_time") -> DataFrame:
    """Turn the causal state columns (``_prior_n``, ``_prev_t``, ``_prior_sum``, ``_prior_cnt``) and
    the row's own fields into the feature columns. Shared by the batch window pass and the
    streaming state processor, so both emit identical features.
    """
    feats = {}
    if spec.amount_log:
        feats["amt_log"] = F.log1p(F.greatest(F.col("amt"), F.lit(0.0).cast("float")))
    if spec.time_deltas:
        feats["dt"] = F.coalesce(F.col(t) - F.col("_prev_t"), F.lit(0))
    if spec.rolling_aggs:
        feats["amt_roll_mean"] = F.when(F.col("_prior_cnt") > 0,
                                        F.col("_prior_sum") / F.col("_prior_cnt")).otherwise(F.lit(0.0))
        feats["amt_count"] = F.col("_prior_n")
    if spec.geo_distance:
        feats["geo_dist"] = F.sqrt(F.pow(F.col("lat") - F.col("merch_lat"), 2)
                                   + F.pow(F.col("long") - F.col("merch_long"), 2))
    if spec.time_features:
        feats["hour"] = hour_utc(t)
        feats["dow"] = dow_monday0(t)
    out = x.select("*", *[e.cast("float").alias(n) for n, e in feats.items()])
    return out.drop(*[c for c in ("_prior_n", "_prev_t", "_prior_sum", "_prior_cnt") if c in out.columns])
