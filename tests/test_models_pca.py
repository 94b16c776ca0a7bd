"""H5 forward pass vs a naive loop, parameter count, F* perturbation property, H6 smoke."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.operators.models import n_params, sequence_scores, tcn_forward, tcn_init
from riskflow.operators.pca import components, triple_pca


def naive_forward(p, x):
    """Direct per-time-step loops of the same causal dilated network."""
    b, length, _ = x.shape
    h = x.astype(np.float64)
    i = 0
    while f"b{i}.w1" in p:
        d = 2 ** i

        def conv(inp, w, bias, dil):
            out = np.zeros((b, length, w.shape[0]))
            for t in range(length):
                acc = np.tile(bias, (b, 1)).astype(np.float64)
                for j in range(w.shape[2]):
                    src = t - (w.shape[2] - 1 - j) * dil
                    if src >= 0:
                        acc += inp[:, src, :] @ w[:, :, j].T
                out[:, t, :] = acc
            return out
        y = np.maximum(conv(h, p[f"b{i}.w1"], p[f"b{i}.c1"], d), 0)
        y = np.maximum(conv(y, p[f"b{i}.w2"], p[f"b{i}.c2"], d), 0)
        res = h if f"b{i}.wd" not in p else conv(h, p[f"b{i}.wd"], p[f"b{i}.cd"], 1)
        h = np.maximum(y + res, 0)
        i += 1
    return (h[:, -1, :] @ p["head.w"].T + p["head.b"])[:, 0]


def test_parameter_count():
    assert n_params(tcn_init(11)) == 64769


def test_forward_equals_naive_loop():
    p = tcn_init(3, channels=(4, 4), seed=1)
    x = np.random.default_rng(0).normal(size=(5, 9, 3)).astype(np.float32)
    assert tcn_forward(p, x, n_blocks=2) == pytest.approx(naive_forward(p, x), rel=1e-4, abs=1e-5)


def test_sequence_scores_distributed(spark):
    p = tcn_init(2, seed=3)
    rows = [(i, [[float(i), 1.0]] * 4) for i in range(20)]
    df = spark.createDataFrame(rows, "tie long, window array<array<float>>")
    got = {r["tie"]: r["logit"] for r in sequence_scores(df, p).collect()}
    x = np.array([w for _, w in rows], dtype=np.float32)
    want = tcn_forward(p, x)
    assert [got[i] for i in range(20)] == pytest.approx(list(want), rel=1e-5)


def test_components_choose_k_and_sign():
    cov = np.diag([5.0, 3.0, 1.0, 1.0])
    c = components(cov, 0.7)
    assert c.shape == (2, 4) and all(row[np.argmax(np.abs(row))] > 0 for row in c)


def test_pca_ignores_non_train_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    y = (rng.random(300) < 0.3).astype(int)
    split = [0] * 200 + [2] * 100
    cols = [f"f{i}" for i in range(5)]
    rows = [(i, int(y[i]), split[i], *map(float, x[i])) for i in range(300)]
    schema = "tie long, y int, split int, " + ", ".join(f"{c} double" for c in cols)
    df = spark.createDataFrame(rows, schema)
    bad = df.select("tie", "y", "split", *[F.when(F.col("split") == 2, F.lit(1e6)).otherwise(F.col(c)).alias(c) for c in cols])
    a, names = triple_pca(df, cols)
    b, names_b = triple_pca(bad, cols)
    assert names == names_b and names[0].startswith("pca_legit_")
    ra = {r["tie"]: [r[n] for n in names] for r in a.where("split = 0").collect()}
    rb = {r["tie"]: [r[n] for n in names] for r in b.where("split = 0").collect()}
    for t in ra:
        assert ra[t] == pytest.approx(rb[t], abs=1e-4)


def test_projections_start_from_the_features_that_are_there(spark, monkeypatch):
    """The second representation joins no transactions and builds no features again, and is what a build of its own gives."""
    from riskflow.plans import build, catalog, catalog_models
    from riskflow.sources import tx_events

    sf = "/root/testdata/sf0.001"
    own = build.build_processed(tx_events(spark, sf), representation="triple_pca")
    catalog.processed(spark, sf)

    def again(*_, **__):
        raise AssertionError("features built again")

    monkeypatch.setattr(build, "features_table", again)
    monkeypatch.setattr(catalog, "_MEMO", {k: v for k, v in catalog._MEMO.items() if k[3] != "processed-pca"})
    got = catalog_models._pca_processed(spark, sf)
    assert got.cut == own.cut and got.maps == own.maps and got.representation == "triple_pca" and list(got.stats) == list(own.stats)
    for name, held in own.stats.items():
        assert all(abs(a - b) < 1e-6 for a, b in zip(got.stats[name], held, strict=True))
    assert got.table.count() == own.table.count()
