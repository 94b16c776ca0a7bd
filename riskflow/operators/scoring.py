"""Scoring (H1-H4, H8): a fixed linear scorer over the processed features.

No trained sequence model ships with the reference, so the registered queries score with a
fixed linear model whose weights are stated below; trained alternatives live in ``models.py``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mathcols import sigmoid

# Weights of our linear scorer on standardised features, and its bias.
LINEAR_WEIGHTS = {
    "amt": -0.3, "amt_log": -0.2, "dt": -0.1, "amt_roll_mean": -0.1, "amt_count": 0.0,
    "geo_dist": -0.9, "hour": 0.0, "dow": 0.0,
    "category_code": -0.3, "gender_code": 0.0, "state_code": 0.0,
}
LINEAR_BIAS = -2.5
DEFAULT_THRESHOLD = 0.5


def linear_logit(weights: dict[str, float] = LINEAR_WEIGHTS, bias: float = LINEAR_BIAS) -> Column:
    z = F.lit(float(bias))
    for c, w in weights.items():
        z = z + F.lit(float(w)) * F.col(c).cast("double")
    return z


def score(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, weights: dict[str, float] = LINEAR_WEIGHTS,
          bias: float = LINEAR_BIAS) -> DataFrame:
    """H1/H2: logit, probability and flag (``prob >= threshold``, inclusive) for every row."""
    z = linear_logit(weights, bias)
    return (df.withColumn("logit", z)
              .withColumn("prob", sigmoid("logit"))
              .withColumn("flag", F.col("prob") >= F.lit(float(threshold))))


def latest_per_card(df: DataFrame, key: str = "user", order: Sequence[str] = ("unix_time", "tie")) -> DataFrame:
    """H3: each card's newest row plus ``rows_considered`` (the card's row count).

    One ``max_by`` aggregate keyed by card: partial aggregation keeps one candidate per card per
    task, so a hot card never lands whole in one task.
    """
    rest = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"),
                              F.count(F.lit(1)).alias("rows_considered"))
    return agg.select(key, *[F.col(f"_last.{c}").alias(c) for c in rest], "rows_considered")


def class_weights(df: DataFrame, y: str = "is_fraud") -> DataFrame:
    """H8: balanced weights n / (2 n_c) and ``scale_pos_weight`` = neg / max(pos, 1)."""
    a = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    neg = F.col("n") - F.col("pos")
    return a.select(
        "n", "pos", neg.alias("neg"),
        F.when(neg > 0, F.col("n") / (2.0 * neg)).alias("w_neg"),
        F.when(F.col("pos") > 0, F.col("n") / (2.0 * F.col("pos"))).alias("w_pos"),
        (neg / F.greatest(F.col("pos"), F.lit(1))).alias("scale_pos_weight"),
    )
