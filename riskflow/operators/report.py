"""Exploratory and leakage report (M1-M13) as distributed aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpoint_dir
from .moments import co_moments
from .ordering import exact_quantiles, ranked, running_totals

LEAK_AUC = 0.95   # fixed value: single-feature AUC above this is a leakage alarm


def overview(tx: DataFrame) -> DataFrame:
    """M1: rows, distinct cards, fraud rate."""
    return tx.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("cc_num").alias("cards"),
                  F.avg(F.col("is_fraud").cast("double")).alias("fraud_rate"))


def class_counts(tx: DataFrame) -> DataFrame:
    """M2."""
    return tx.groupBy("is_fraud").agg(F.count(F.lit(1)).alias("n"))


def monthly_drift(tx: DataFrame) -> DataFrame:
    """M3: rows and fraud rate per calendar month (UTC) of ``unix_time``; zone-free arithmetic."""
    day = F.date_from_unix_date(F.floor(F.col("unix_time") / 86400).cast("int"))
    month = F.date_format(F.trunc(day, "month"), "yyyy-MM")
    return tx.groupBy(month.alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col("is_fraud").cast("double")).alias("fraud_rate"))


def cut_lines(tx: DataFrame, qs: Sequence[float] = (0.7, 0.8)) -> DataFrame:
    """M4: interpolated time quantiles (the notebook's 70 % / 80 % lines), exact and distributed."""
    q = exact_quantiles(tx, "unix_time", list(qs))
    return q.select(*[F.col(f"q_{i}").alias(f"t_q{int(round(v * 100))}") for i, v in enumerate(qs)])


def per_card_counts(tx: DataFrame, key: str = "cc_num") -> DataFrame:
    return tx.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def describe_counts(tx: DataFrame, key: str = "cc_num") -> DataFrame:
    """M5: describe() of transactions per card: count, mean, sample std, min, quartiles, max.

    Every figure comes from the counts of equal counts (one row per distinct count, at most about the square root
    of twice the rows), so the fact table is aggregated once.
    """
    sizes = per_card_counts(tx, key).groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    n, c = F.col("n").cast("double"), F.col("c").cast("double")
    total, mean = F.sum(c), F.sum(n * c) / F.sum(c)
    spread = F.sum(n * n * c) - F.sum(n * c) * F.sum(n * c) / total
    quartile = lambda q: F.percentile("n", F.lit(q), F.col("c"))
    return sizes.agg(F.sum("c").alias("count"), mean.alias("mean"), F.when(total > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (total - 1))).alias("std"),
                     F.min("n").cast("double").alias("min"), quartile(0.25).alias("p25"), quartile(0.5).alias("p50"), quartile(0.75).alias("p75"),
                     F.max("n").cast("double").alias("max"))


def histogram(df: DataFrame, value: str, bins: int, by: str | None = None, density: bool = False) -> DataFrame:
    """M6: equal-width histogram over [min, max] (per group when ``by``), last bin closed.

    Empty bins are omitted; ``density`` = n / (N * width).
    """
    g = [by] if by else []
    rng = df.where(F.col(value).isNotNull()).groupBy(*g).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_N"))
    if g:                                              # null is a group too
        rng = rng.withColumnRenamed(by, "_by")
        j = df.join(rng, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    else:
        r = rng.first()
        j = df.select("*", F.lit(r["_lo"]).alias("_lo"), F.lit(r["_hi"]).alias("_hi"), F.lit(r["_N"]).alias("_N"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    pos = F.when(F.col("_hi") > F.col("_lo"),
                 F.floor((F.col(value) - F.col("_lo")) * F.lit(bins) / (F.col("_hi") - F.col("_lo")))).otherwise(0)
    b = F.least(pos, F.lit(bins - 1)).cast("int")
    h = j.where(F.col(value).isNotNull()).groupBy(*g, b.alias("bin"), "_lo", "_hi", "_N").agg(F.count(F.lit(1)).alias("n"))
    w = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    cols = [*g, "bin", (F.col("_lo") + F.col("bin") * w).alias("left"), (F.col("_lo") + (F.col("bin") + 1) * w).alias("right"), "n"]
    if density:
        cols.append(F.when(w > 0, F.col("n") / (F.col("_N") * w)).alias("density"))
    return h.select(*cols)


def median_by_class(tx: DataFrame, value: str = "amt", by: str = "is_fraud") -> DataFrame:
    """M7: exact median per class; the few class groups may be very large, so no group is collected."""
    return exact_quantiles(tx, value, [0.5], by).select(by, F.col("q_0").alias("median_amt"))


def boxplot(tx: DataFrame, value: str = "amt", by: str = "is_fraud") -> DataFrame:
    """M8: quartiles, IQR, whiskers (furthest values within 1.5 IQR of the box) and outlier count."""
    q = exact_quantiles(tx, value, [0.25, 0.5, 0.75], by).select(
        by, F.col("q_0").alias("q1"), F.col("q_1").alias("median"), F.col("q_2").alias("q3"))
    q = q.withColumnRenamed(by, "_by")       # null is a class too; Spark broadcasts q by its size
    j = tx.where(ranked(tx, value)).join(q, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    v = F.col(value)
    return j.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(v >= lo_f, v)).alias("whisker_lo"), F.max(F.when(v <= hi_f, v)).alias("whisker_hi"),
        F.sum(F.when((v < lo_f) | (v > hi_f), 1).otherwise(0)).alias("outliers")
    ).withColumn("iqr", F.col("q3") - F.col("q1"))


def rate_by(tx: DataFrame, key, name: str) -> DataFrame:
    """Size and fraud rate per key."""
    return tx.groupBy(key.alias(name) if not isinstance(key, str) else F.col(key).alias(name)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("is_fraud").cast("double")).alias("fraud_rate"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every feature pair from one pass of merged co-moments, long form (f1, f2, r).

    A pair counts the rows in which both are present; r is null where a column does not vary.
    """
    states = co_moments(df, cols)
    r = states[None].correlation() if states else np.full((len(cols), len(cols)), np.nan)
    rows = [(a, b, None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    return df.sparkSession.createDataFrame(rows, "f1 string, f2 string, r double")


def feature_auc(df: DataFrame, cols: Sequence[str], y: str = "is_fraud") -> DataFrame:
    """Single-feature ROC-AUC (ties half), reported as max(auc, 1 - auc), ranked.

    Unpivot to (feature, value) -> per-value class counts -> cumulative negatives along
    (feature, value) with the bucketed running totals -> one aggregate per feature.
    """
    checkpoint_dir(df.sparkSession)
    long = df.select(F.col(y).cast("long").alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])).alias("_s"))
    counts = (long.where(F.col("_s.value").isNotNull())
                  .groupBy(F.struct(F.col("_s.feature").alias("feature"), F.col("_s.value").alias("value")).alias("key"))
                  .agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))).checkpoint()
    cum = running_totals(counts, "key", ["neg"])
    tot = counts.groupBy(F.col("key.feature").alias("feature")).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    prev = F.sum("N").over(Window.partitionBy(F.lit(0)).orderBy("feature").rowsBetween(Window.unboundedPreceding, -1))
    tot = tot.withColumn("_before", F.coalesce(prev, F.lit(0)))   # one row per feature
    j = cum.join(F.broadcast(tot), F.col("key.feature") == F.col("feature"))
    below = F.col("cum_neg") - F.col("neg") - F.col("_before")
    a = j.groupBy("feature", "P", "N").agg(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)).alias("_s"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_s") / (F.col("P") * F.col("N")))
    return a.select("feature", F.greatest(auc, 1 - auc).alias("auc"))


def leak_alarm(aucs: DataFrame, limit: float = LEAK_AUC) -> DataFrame:
    """Any single-feature AUC above ``limit``."""
    return aucs.agg(F.max("auc").alias("max_auc"), (F.max("auc") > F.lit(limit)).alias("alarm"))

