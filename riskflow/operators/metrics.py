"""Exact imbalanced-class evaluation (I1-I9), fully distributed.

Everything starts from ``groupBy(score) -> (pos, neg)``: a hot score value collapses to one row in
the map-side partial aggregate. Cumulative counts along descending score use the bucketed
``running_totals``; only 1-row totals reach the driver.

Definitions (thresholds are the distinct scores; ``>=`` predicts positive):
  precision = tp/(tp+fp), recall = tp/P (1 when P = 0), f1 = 2pr/(p+r) or 0;
  average precision = sum over thresholds of (pos at s / P) * precision(s), 0 when P = 0;
  ROC-AUC = sum pos_s * (neg below s + neg_s / 2) / (P * N), NULL for a single class;
  best-F1 threshold = max F1, lowest threshold on ties, 0.5 when there is no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathcols import bce_with_logits, focal_with_logits
from ..session import checkpoint_dir
from .ordering import running_totals

NO_THRESHOLD = 0.5


def score_counts(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    yy = F.col(y).cast("long")
    return (df.where(F.col(score).isNotNull())
              .groupBy(F.col(score).cast("double").alias("threshold"))
              .agg(F.sum(yy).alias("pos"), F.sum(1 - yy).alias("neg")))


def pr_curve(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """One row per distinct score with tp, fp, precision, recall, f1 (plus P, N totals)."""
    checkpoint_dir(df.sparkSession)
    counts = score_counts(df, score, y).checkpoint()
    tot = counts.agg(F.count(F.lit(1)).alias("k"), F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    k, P, N = int(tot["k"]), int(tot["P"] or 0), int(tot["N"] or 0)
    cum = running_totals(counts, "threshold", ["pos", "neg"], descending=True, n_rows=k)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    recall = (tp / F.lit(P)) if P > 0 else F.lit(1.0)
    out = cum.select("threshold", "pos", "neg", tp.alias("tp"), fp.alias("fp"),
                     precision.alias("precision"), recall.alias("recall"),
                     F.lit(P).cast("bigint").alias("P"), F.lit(N).cast("bigint").alias("N"))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))


def curve_summary(curve: DataFrame, threshold: float | None = None) -> DataFrame:
    """I1 + I2 (+ I4 at ``threshold``) in one aggregate over the curve."""
    P, N = F.first("P"), F.first("N")
    ap = F.when(P > 0, F.sum(F.col("pos") * F.col("precision")) / P).otherwise(F.lit(0.0))
    auc = F.when((P > 0) & (N > 0),
                 F.sum(F.col("pos") * (F.col("N") - F.col("fp") + F.col("neg") / 2.0)) / (P * N))
    cols = [ap.alias("pr_auc"), auc.alias("roc_auc")]
    if threshold is not None:
        hit = F.col("threshold") >= F.lit(float(threshold))
        tp = F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0))
        fp = F.coalesce(F.sum(F.when(hit, F.col("neg"))), F.lit(0))
        cols += [tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"),
                 (P - tp).cast("bigint").alias("fn"), (N - fp).cast("bigint").alias("tn")]
    return curve.agg(*cols)


def pr_auc(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    return curve_summary(pr_curve(df, score, y)).select("pr_auc")


def roc_auc(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    return curve_summary(pr_curve(df, score, y)).select("roc_auc")


def best_f1(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """One row ``(threshold, f1)``: a ``max_by`` aggregate (partial per task, no global sort).

    Ordering key (f1, -threshold) picks the lowest threshold among equal F1 values.
    """
    curve = pr_curve(df, score, y)
    best = F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold")))
    return curve.agg(best.alias("b")).select(
        F.coalesce(F.col("b.threshold"), F.lit(NO_THRESHOLD)).alias("threshold"),
        F.coalesce(F.col("b.f1"), F.lit(0.0)).alias("f1"))


def best_threshold(df: DataFrame, score: str = "score", y: str = "y") -> float:
    r = best_f1(df, score, y).first()
    return float(r["threshold"])


def metrics_at(df: DataFrame, threshold: float, score: str = "score", y: str = "y") -> DataFrame:
    """I4: pr_auc, roc_auc, confusion counts, precision, recall, f1 at ``threshold`` (0 on 0/0)."""
    s = curve_summary(pr_curve(df, score, y), threshold)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    return s.select("pr_auc", "roc_auc", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                    F.lit(float(threshold)).alias("threshold"), "tp", "fp", "fn", "tn")


def tune_and_report(scored: DataFrame, score: str = "score", y: str = "y", split: str = "split") -> DataFrame:
    """Best-F1 threshold on VAL (split 1), metrics on TEST (split 2) at that threshold."""
    thr = best_threshold(scored.where(F.col(split) == 1), score, y)
    return metrics_at(scored.where(F.col(split) == 2), thr, score, y)


def focal_loss(df: DataFrame, logit: str = "logit", y: str = "y", alpha: float = 0.25, gamma: float = 2.0) -> DataFrame:
    """Mean focal loss on logits (alpha < 0 disables class weighting; gamma 0 = weighted BCE)."""
    return df.agg(F.avg(focal_with_logits(logit, y, alpha, gamma)).alias("focal_loss"))


def bce_loss(df: DataFrame, logit: str = "logit", y: str = "y") -> DataFrame:
    """I8: mean binary cross entropy on logits."""
    return df.agg(F.avg(bce_with_logits(logit, y)).alias("bce_loss"))


#: I8: mean losses on logits by name
LOSSES = {"focal": focal_loss, "bce": bce_loss}


def mean_loss(df: DataFrame, name: str, **options) -> DataFrame:
    """I8: the named loss over ``df``; options go to it. Unknown names are an error."""
    if name not in LOSSES:
        raise ValueError(f"no loss is called {name!r}; known: {', '.join(sorted(LOSSES))}")
    return LOSSES[name](df, **options)


def latency_summary(df: DataFrame, col: str = "latency_ms") -> DataFrame:
    """Exact p50 / p99 with linear interpolation (numpy's default), by counting bisection:
    Spark's exact ``percentile`` would buffer every value in one aggregation buffer."""
    from .ordering import exact_quantiles
    q = exact_quantiles(df, col, [0.5, 0.99])
    return q.select(F.col("q_0").alias("p50"), F.col("q_1").alias("p99"), F.col("n"))
