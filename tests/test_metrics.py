"""I1-I8 against brute-force definitions, including ties, one class and empty input."""

import math
import random

import numpy as np
import pytest

from riskflow.operators import metrics as M


def brute(scores, ys):
    P = sum(ys)
    N = len(ys) - P
    th = sorted(set(scores), reverse=True)
    ap, best = 0.0, (None, -1.0)
    for t in th:
        tp = sum(1 for s, y in zip(scores, ys) if s >= t and y)
        fp = sum(1 for s, y in zip(scores, ys) if s >= t and not y)
        pos_t = sum(1 for s, y in zip(scores, ys) if s == t and y)
        prec = tp / (tp + fp)
        rec = tp / P if P else 1.0
        if P:
            ap += pos_t / P * prec
        f1 = 2 * prec * rec / (prec + rec) if prec + rec > 0 else 0.0
        if f1 > best[1] or (f1 == best[1] and t < best[0]):
            best = (t, f1)
    auc = None
    if P and N:
        num = sum((1.0 if sp > sn else 0.5 if sp == sn else 0.0)
                  for sp, yp in zip(scores, ys) if yp for sn, yn in zip(scores, ys) if not yn)
        auc = num / (P * N)
    return ap, auc, best


def scored(spark, scores, ys):
    return spark.createDataFrame([(float(s), int(y)) for s, y in zip(scores, ys)], "score double, y int")


def test_against_brute_force_with_ties(spark):
    rnd = random.Random(3)
    scores = [round(rnd.random(), 1) for _ in range(200)]
    ys = [int(rnd.random() < 0.3) for _ in range(200)]
    df = scored(spark, scores, ys)
    ap, auc, (thr, f1) = brute(scores, ys)
    s = M.curve_summary(M.pr_curve(df)).first()
    assert s["pr_auc"] == pytest.approx(ap)
    assert s["roc_auc"] == pytest.approx(auc)
    b = M.best_f1(df).first()
    assert b["threshold"] == pytest.approx(thr) and b["f1"] == pytest.approx(f1)


def test_six_rows(spark):
    df = scored(spark, [0.9, 0.8, 0.8, 0.4, 0.3, 0.1], [1, 1, 0, 0, 1, 0])
    s = M.curve_summary(M.pr_curve(df)).first()
    ap, auc, _ = brute([0.9, 0.8, 0.8, 0.4, 0.3, 0.1], [1, 1, 0, 0, 1, 0])
    assert s["pr_auc"] == pytest.approx(ap) and s["roc_auc"] == pytest.approx(auc)


def test_bucketed_curve_equals_single_bucket(spark, monkeypatch):
    rnd = random.Random(5)
    scores = [rnd.random() for _ in range(300)]
    ys = [int(rnd.random() < 0.2) for _ in range(300)]
    df = scored(spark, scores, ys)
    a = M.curve_summary(M.pr_curve(df)).first()
    import riskflow.operators.ordering as O
    monkeypatch.setattr(O, "ROWS_PER_BUCKET", 17)
    monkeypatch.setattr(M, "running_totals", lambda *a, **k: O.running_totals(*a, **{**k, "rows_per_bucket": 17}))
    b = M.curve_summary(M.pr_curve(df)).first()
    assert a["pr_auc"] == pytest.approx(b["pr_auc"]) and a["roc_auc"] == pytest.approx(b["roc_auc"])


def test_single_class_and_empty(spark):
    s = M.curve_summary(M.pr_curve(scored(spark, [0.2, 0.3], [0, 0]))).first()
    assert s["pr_auc"] == 0.0 and s["roc_auc"] is None
    empty = spark.createDataFrame([], "score double, y int")
    assert M.best_f1(empty).first()["threshold"] == 0.5


def test_metrics_at_threshold(spark):
    df = scored(spark, [0.9, 0.6, 0.5, 0.2], [1, 0, 1, 0])
    m = M.metrics_at(df, 0.5).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (2, 1, 0, 1)
    assert m["precision"] == pytest.approx(2 / 3) and m["recall"] == 1.0


def test_losses(spark):
    df = spark.createDataFrame([(2.0, 1), (-1.0, 0), (0.5, 0)], "logit double, y int")
    z = np.array([2.0, -1.0, 0.5]); y = np.array([1, 0, 0])
    p = 1 / (1 + np.exp(-z))
    bce = np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))
    assert M.bce_loss(df).first()[0] == pytest.approx(bce.mean())
    pt = p * y + (1 - p) * (1 - y)
    at = 0.25 * y + 0.75 * (1 - y)
    assert M.focal_loss(df).first()[0] == pytest.approx((at * bce * (1 - pt) ** 2).mean())
    assert M.focal_loss(df, alpha=-1, gamma=0).first()[0] == pytest.approx(bce.mean())
    with pytest.raises(ValueError):
        M.mean_loss(df, "hinge")


def test_latency_summary(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 101)], "latency_ms double")
    r = M.latency_summary(df).first()
    assert r["p50"] == pytest.approx(np.percentile(range(1, 101), 50))
    assert r["p99"] == pytest.approx(np.percentile(range(1, 101), 99))
