"""Alert parsing, enrichment and decision rules (K1-K6), set-oriented.

An alert is ``{"tx": {...}, "prob": p[, "decision": {...}]}``. Parsing separates valid alerts from
a quarantine instead of raising; every valid alert gets exactly one decision: a supplied
structured one, else an extracted one, else the threshold fallback.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import card_key
from ..schema import BLOCK_THRESHOLD, REVIEW_THRESHOLD
from ..session import checkpoint_dir, scratch_path
from .lookups import RECENT_K, card_profile, recent_arrays, segment_rates

ACTIONS = ("block", "review", "allow")  # fixed values
FALLBACK_RATIONALE = "fallback"
ENRICHED = ["tx_count", "median_amt", "avg_amt", "top_categories", "home_state", "recent", "segment_rate"]
KEYS_BROADCAST_MAX = 500_000    # alerted cards or segments sent to every task, at most; more are joined by a shuffle

TX_FIELDS = T.StructType([
    T.StructField("cc_num", T.StringType()), T.StructField("user_id", T.StringType()),
    T.StructField("amt", T.DoubleType()), T.StructField("category", T.StringType()),
    T.StructField("state", T.StringType()), T.StructField("unix_time", T.LongType()),
    T.StructField("merch_lat", T.DoubleType()), T.StructField("merch_long", T.DoubleType()),
])
DECISION = T.StructType([
    T.StructField("action", T.StringType()), T.StructField("rationale", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])
ALERT = T.StructType([
    T.StructField("tx", TX_FIELDS), T.StructField("prob", T.DoubleType()),
    T.StructField("decision", DECISION),
])
_CORRUPT = "_corrupt"      # filled by the JSON reader with text that is not JSON of the schema


def alert_payload(scored: DataFrame, prob: str = "prob") -> DataFrame:
    """A8 payload: ``key`` = card id, ``value`` = alert JSON (flagged rows only: caller filters)."""
    tx = F.struct(F.col("cc_num").cast("string").alias("cc_num"), F.col("amt").cast("double").alias("amt"),
                  "category", "state", F.col("unix_time").cast("long").alias("unix_time"),
                  F.col("merch_lat").cast("double").alias("merch_lat"), F.col("merch_long").cast("double").alias("merch_long"))
    return scored.select(F.col("tie").alias("alert_id"), card_key(scored).alias("key"),
                         F.to_json(F.struct(tx.alias("tx"), F.col(prob).alias("prob"))).alias("value"))


def parse_alerts(df: DataFrame, col: str = "value") -> DataFrame:
    """K1: decode and validate. Required: amt, category, state, unix_time; prob in [0, 1].

    Adds ``card_id`` (cc_num, else user_id, else 'unknown'), the typed fields, ``valid`` and
    ``error``; invalid rows are kept for a quarantine sink instead of failing the batch.
    """
    a = F.from_json(F.col(col), T.StructType([*ALERT.fields, T.StructField(_CORRUPT, T.StringType())]), {"columnNameOfCorruptRecord": _CORRUPT})
    x = df.withColumn("_a", a)
    tx = F.col("_a.tx")
    checks = [
        (F.col("_a").isNull() | F.col(f"_a.{_CORRUPT}").isNotNull(), "unparseable alert"),
        (tx.isNull(), "missing tx"),
        (tx["amt"].isNull(), "missing amt"),
        (tx["category"].isNull(), "missing category"),
        (tx["state"].isNull(), "missing state"),
        (tx["unix_time"].isNull(), "missing unix_time"),
        (F.col("_a.prob").isNull() | (F.col("_a.prob") < 0) | (F.col("_a.prob") > 1), "prob outside [0, 1]"),
    ]
    err = F.lit(None).cast("string")
    for cond, msg in reversed(checks):
        err = F.when(cond, F.lit(msg)).otherwise(err)
    return x.select(
        "*",
        F.coalesce(tx["cc_num"], tx["user_id"], F.lit("unknown")).alias("card_id"),
        tx["amt"].alias("amt"), tx["category"].alias("category"), tx["state"].alias("state"),
        tx["unix_time"].alias("unix_time"), tx["merch_lat"].alias("merch_lat"), tx["merch_long"].alias("merch_long"),
        F.col("_a.prob").alias("score"), F.col("_a.decision").alias("supplied_decision"),
        err.alias("error"),
    ).withColumn("valid", F.col("error").isNull()).drop("_a")


def fallback_decision(score: Column, review: float = REVIEW_THRESHOLD, block: float = BLOCK_THRESHOLD) -> Column:
    """K3: >= block -> block, >= review -> review, else allow; rationale 'fallback', confidence = score."""
    action = F.when(score >= F.lit(block), F.lit("block")).when(score >= F.lit(review), F.lit("review")).otherwise(F.lit("allow"))
    return F.struct(action.alias("action"), F.lit(FALLBACK_RATIONALE).alias("rationale"),
                    score.cast("double").alias("confidence"))


def checked_decision(d: Column) -> Column:
    """A decision struct when it satisfies the contract (known action; confidence null or in [0, 1])."""
    ok = (d.isNotNull() & d["action"].isin(*ACTIONS) & d["rationale"].isNotNull()
          & (d["confidence"].isNull() | d["confidence"].between(0.0, 1.0)))
    return F.when(ok, F.struct(d["action"].alias("action"), d["rationale"].alias("rationale"),
                               d["confidence"].cast("double").alias("confidence")))


def resolve(alerts: DataFrame, key: str = "alert_id", structured: DataFrame | None = None,
            extracted: DataFrame | None = None, review: float = REVIEW_THRESHOLD,
            block: float = BLOCK_THRESHOLD) -> DataFrame:
    """K4: one decision per alert from three tiers (structured, extracted, fallback).

    Tier tables hold ``(key, action, rationale, confidence)``; invalid entries count as absent.
    The supplied ``decision`` inside an alert, when present, is used as the structured tier.
    """
    x = alerts
    tiers: list[tuple[str, Column]] = []
    if "supplied_decision" in x.columns:
        tiers.append(("supplied", checked_decision(F.col("supplied_decision"))))
    for name, t in (("structured", structured), ("extracted", extracted)):
        if t is not None:
            d = t.select(F.col(key), checked_decision(F.struct("action", "rationale", F.col("confidence").cast("double").alias("confidence"))).alias("_d"))
            # of several valid decisions for a key, the first by (action, rationale, confidence) counts
            d = d.where(F.col("_d").isNotNull()).groupBy(key).agg(F.min("_d").alias(f"_{name}"))
            x = x.join(d, key, "left")
            tiers.append((name, F.col(f"_{name}")))
    dec = F.coalesce(*(t for _, t in tiers), fallback_decision(F.col("score"), review, block))
    source = F.lit("fallback")
    for name, t in reversed(tiers):
        source = F.when(t.isNotNull(), F.lit(name)).otherwise(source)
    out = x.withColumn("decision", dec).withColumn("decision_source", source)
    return out.drop("_structured", "_extracted")


@dataclass
class Lookups:
    """What the three lookups return, as tables: a row per card (profile, recent) and a row per segment (rate)."""
    cards: DataFrame
    segments: DataFrame


def _cards(own: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Profile and recent k (``time@cents`` joined by ';', oldest first) of every card of ``own``."""
    recent = recent_arrays(own, asked, k=k).select("card_id", F.concat_ws(";", F.transform(
        "recent", lambda v: F.concat_ws("@", v["unix_time"].cast("string"), F.round(v["amt"] * 100).cast("long").cast("string")))).alias("recent"))
    return card_profile(own).join(recent, "card_id", "left")


def _segments(rows: DataFrame) -> DataFrame:
    return segment_rates(rows).select("category", "state", F.col("fraud_rate").alias("segment_rate"))


def lookups(tx: DataFrame, k: int = RECENT_K) -> Lookups:
    """The lookups of a whole history, computed once and written to the shared folder, for the many batches of a stream."""
    spark, base = tx.sparkSession, scratch_path(tx.sparkSession, "lookups")
    x = tx.withColumn("card_id", F.col("cc_num").cast("string"))
    own = x.where(F.col("card_id").isNotNull())
    _cards(own, own.select("card_id"), k).write.parquet(f"{base}/cards")
    _segments(x).write.parquet(f"{base}/segments")
    return Lookups(spark.read.parquet(f"{base}/cards"), spark.read.parquet(f"{base}/segments"))


def attach(alerts: DataFrame, found: Lookups) -> DataFrame:
    """K2 on prepared lookups. The cards go through a shuffle, never through the driver; there are few segments."""
    return (alerts.join(found.cards.hint("shuffle_hash"), "card_id", "left").join(found.segments, ["category", "state"], "left")
                  .withColumn("segment_rate", F.coalesce("segment_rate", F.lit(0.0))))


def enrich(alerts: DataFrame, tx: DataFrame, k: int = RECENT_K) -> DataFrame:
    """K2: each alert with what the three lookups return: profile, recent k (``time@cents`` joined
    by ';', oldest first) and the segment fraud rate (0.0 when unseen).

    The alerts are computed once. The history is cut in one pass to the rows of their cards and segments, written to the
    shared folder; the lookups read their columns of that, so they cost what was alerted. A stream, which would read the
    history once for each batch, takes ``lookups`` and ``attach`` instead.
    """
    spark = tx.sparkSession
    checkpoint_dir(spark)
    alerts = alerts.checkpoint()
    small = F.broadcast if alerts.count() <= KEYS_BROADCAST_MAX else (lambda df: df)
    cards = alerts.select("card_id").distinct()
    segments = alerts.select("category", "state").distinct()
    x = tx.select(F.col("cc_num").cast("string").alias("card_id"), "unix_time", "tie", "amt", "category", "state", "is_fraud")
    x = x.join(small(cards.withColumn("_own", F.lit(True))), "card_id", "left").join(small(segments.withColumn("_seg", F.lit(True))), ["category", "state"], "left")
    path = scratch_path(spark, "alerted")
    x.where("_own OR _seg").write.parquet(path)
    near = spark.read.parquet(path)
    own = near.where("_own").withColumn("cc_num", F.col("card_id"))
    return attach(alerts, Lookups(_cards(own, cards, k), _segments(near.where("_seg"))))


def plain_decimal(c: Column) -> Column:
    """A double in plain decimal notation with at least one digit behind the point (``10000000.0``)."""
    text = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,12)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.coalesce(text, c.cast("string"))


def alert_text(df: DataFrame) -> Column:
    """K6: one-line alert summary: card, score (3 dp), amount, category, state, time."""
    return F.format_string("Flagged transaction on card %s (model fraud score %.3f).\nAmount: %s, category: %s, state: %s, unix_time: %d.",
                           F.col("card_id"), F.col("score"), plain_decimal(F.col("amt")), F.col("category"),
                           F.col("state"), F.col("unix_time"))
