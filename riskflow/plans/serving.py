"""Serving-shaped jobs as set operations: request scoring (H4), latest per card (H3), feeds (A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.encode import apply_categories, apply_scaler, assemble
from ..operators.features import causal_features
from ..operators.scoring import score
from ..schema import SEQ_LEN
from .build import Processed, feature_columns

TEXT = ("cc_num", "category", "gender", "state")
NUMBERS = ("amt", "lat", "long", "merch_lat", "merch_long")
REQUEST_TX = T.StructType([
    T.StructField("unix_time", T.LongType()), T.StructField("tie", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in TEXT],
    *[T.StructField(c, T.DoubleType()) for c in NUMBERS],
])


def history_requests(tx: DataFrame, keys: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """Stand-in request table ``(request_id, txs)``: each requested card's last ``seq_len`` rows,
    oldest first (a bounded array per request); ids without rows get an empty array.
    """
    w = Window.partitionBy("cc_num").orderBy(F.col("unix_time").desc(), F.col("tie").desc())
    last = tx.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= seq_len)
    item = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REQUEST_TX.fields])
    per = last.groupBy(F.col("cc_num").cast("string").alias("request_id")).agg(F.sort_array(F.collect_list(item)).alias("txs"))
    empty = F.array().cast(T.ArrayType(REQUEST_TX))
    return keys.join(per, "request_id", "left").select("request_id", F.coalesce("txs", empty).alias("txs"))


def _request_rows(requests: DataFrame, p: Processed) -> DataFrame:
    """Every row of the inline histories (one empty row where there is none) with its causal features; missing text
    is '' and missing numbers are 0.0."""
    rows = requests.select("request_id", F.posexplode_outer("txs").alias("pos", "t"))
    cols = [F.coalesce(F.col(f"t.{c}"), F.lit("")).alias(c) for c in TEXT] + \
           [F.coalesce(F.col(f"t.{c}"), F.lit(0.0)).alias(c) for c in NUMBERS]
    x = rows.select("request_id", "pos", F.col("t").isNull().alias("_empty"),
                    F.coalesce(F.col("t.unix_time"), F.lit(0)).alias("unix_time"), *cols)
    return causal_features(x, p.spec, key="request_id", order=("unix_time", "pos"))


def _coded(rows: DataFrame, p: Processed) -> DataFrame:
    return apply_scaler(apply_categories(rows, p.maps, list(p.spec.categorical), p.category_map), p.stats)


def score_requests(requests: DataFrame, p: Processed, threshold: float) -> DataFrame:
    """H4: stateless scoring of inline histories with the train-fit maps and scaler.

    Features come from the supplied rows only, the newest row is scored, and an empty history scores an all-zero
    feature vector.
    """
    feats = _request_rows(requests, p)
    w = Window.partitionBy("request_id").orderBy(F.col("unix_time").desc(), F.col("pos").desc())
    last = (feats.withColumn("_r", F.row_number().over(w))
                 .withColumn("n_rows", F.sum(F.when(F.col("_empty"), 0).otherwise(1)).over(Window.partitionBy("request_id")))
                 .where(F.col("_r") == 1))
    coded = _coded(last, p)
    fc = feature_columns(p)
    zeroed = coded.select(*[F.when(F.col("_empty"), F.lit(0.0)).otherwise(F.col(c).cast("double")).alias(c)
                            if c in fc else F.col(c) for c in coded.columns])
    s = score(zeroed, threshold)
    return s.select("request_id", F.col("n_rows").cast("bigint").alias("n_rows"), "logit", "prob", "flag")


def request_windows(requests: DataFrame, p: Processed, seq_len: int = SEQ_LEN) -> DataFrame:
    """``(request_id, window)``: the feature vectors of the last ``seq_len`` rows of each inline history, oldest first,
    zero vectors in front of shorter ones (all zeros for an empty history)."""
    fc = feature_columns(p)
    coded = _coded(_request_rows(requests, p), p)
    step = F.when(~F.col("_empty"), F.struct("unix_time", "pos", assemble(fc).alias("v")))
    per = coded.groupBy("request_id").agg(F.sort_array(F.collect_list(step)).alias("_steps"))
    own = F.transform(F.slice("_steps", F.greatest(F.size("_steps") - seq_len + 1, F.lit(1)), F.lit(seq_len)), lambda s: s["v"])
    zero = F.array_repeat(F.array(*[F.lit(0.0).cast("float")] * len(fc)), F.greatest(F.lit(seq_len) - F.size("_steps"), F.lit(0)))
    return per.select("request_id", F.concat(zero, own).alias("window"))


def scored_feed(scored: DataFrame, threshold: float) -> DataFrame:
    """A10: card, time, amount, category, state, probability (4 dp), flag, in (time, tie) order."""
    return (scored.select(F.col("cc_num").cast("string").alias("card_id"), "unix_time", F.col("amt_raw").alias("amt"),
                          "category", "state", F.round(F.col("prob").cast("decimal(38,10)"), 4).cast("double").alias("fraud_probability"),
                          (F.col("prob") >= F.lit(threshold)).alias("is_fraud"), "tie")
                  .orderBy("unix_time", "tie"))


def write_feed(feed: DataFrame, path: str) -> None:
    """A10 sink: NDJSON files, globally ordered by (time, tie) through range partitioning."""
    feed.write.mode("overwrite").json(path)
