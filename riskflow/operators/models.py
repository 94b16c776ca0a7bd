"""Model scoring and tabular baselines (H5-H7).

H5 runs a causal temporal-convolution network's forward pass in ``mapInPandas``: Arrow batches of
windows in, logits out, weights shipped once with the function (about 65k floats, fixed size).
No trained checkpoint ships with the reference, so the weights come from an ``.npz`` file when one
is given and from a seeded initialisation otherwise. H6 trains on the TRAIN split with Spark ML, H7 with ``boosting``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TRAIN
from . import boosting
from .boosting import BoostedTrees

CHANNELS = (64, 64, 64)   # fixed values: hidden channels per block, kernel size
KERNEL = 3


def tcn_init(n_features: int, channels: Sequence[int] = CHANNELS, kernel: int = KERNEL, seed: int = 0) -> dict:
    """Seeded weights with uniform(+-1/sqrt(fan_in)) like common framework defaults."""
    rng = np.random.default_rng(seed)
    p: dict[str, np.ndarray] = {}

    def u(shape, fan_in):
        b = 1.0 / np.sqrt(fan_in)
        return rng.uniform(-b, b, size=shape).astype(np.float32)

    c_in = n_features
    for i, c_out in enumerate(channels):
        p[f"b{i}.w1"], p[f"b{i}.c1"] = u((c_out, c_in, kernel), c_in * kernel), u((c_out,), c_in * kernel)
        p[f"b{i}.w2"], p[f"b{i}.c2"] = u((c_out, c_out, kernel), c_out * kernel), u((c_out,), c_out * kernel)
        if c_in != c_out:
            p[f"b{i}.wd"], p[f"b{i}.cd"] = u((c_out, c_in, 1), c_in), u((c_out,), c_in)
        c_in = c_out
    p["head.w"], p["head.b"] = u((1, c_in), c_in), u((1,), c_in)
    return p


def n_params(p: dict) -> int:
    return int(sum(v.size for v in p.values()))


def _causal_conv(x: np.ndarray, w: np.ndarray, b: np.ndarray, dilation: int) -> np.ndarray:
    """x (B, L, Cin), w (Cout, Cin, K): out[t] = b + sum_j w[:, :, j] x[t - (K-1-j) * dilation]."""
    _, length, _ = x.shape
    k = w.shape[2]
    out = np.broadcast_to(b, x.shape[:2] + (w.shape[0],)).astype(np.float32).copy()
    for j in range(k):
        shift = (k - 1 - j) * dilation
        if shift >= length:
            continue
        src = x[:, : length - shift, :]
        out[:, shift:, :] += np.einsum("blc,oc->blo", src, w[:, :, j], optimize=True)
    return out


def tcn_forward(p: dict, x: np.ndarray, n_blocks: int = len(CHANNELS)) -> np.ndarray:
    """Logits for windows ``x`` of shape (B, L, F); the head reads the last time step."""
    h = x.astype(np.float32)
    for i in range(n_blocks):
        d = 2 ** i
        y = np.maximum(_causal_conv(h, p[f"b{i}.w1"], p[f"b{i}.c1"], d), 0)
        y = np.maximum(_causal_conv(y, p[f"b{i}.w2"], p[f"b{i}.c2"], d), 0)
        res = h if f"b{i}.wd" not in p else _causal_conv(h, p[f"b{i}.wd"], p[f"b{i}.cd"], 1)
        h = np.maximum(y + res, 0)
    return (h[:, -1, :] @ p["head.w"].T + p["head.b"])[:, 0]


def load_weights(path: str | None, n_features: int) -> dict:
    if path:
        with np.load(path) as z:
            return {k: z[k].astype(np.float32) for k in z.files}
    return tcn_init(n_features)


def sequence_scores(windows: DataFrame, weights: dict, key: str = "tie", window: str = "window") -> DataFrame:
    """H5: ``(key, logit, prob)`` for every window row, computed per Arrow batch."""
    from ..session import ship_package
    ship_package(windows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack([np.stack(w) for w in pdf[window]]).astype(np.float32)
            z = tcn_forward(weights, x).astype(np.float64)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "logit": z, "prob": 1.0 / (1.0 + np.exp(-z))})

    return windows.select(key, window).mapInPandas(run, f"{key} long, logit double, prob double")


def _assembled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep").transform(
        df.select("*", *[F.col(c).cast("double").alias(f"_f_{c}") for c in cols]).drop(*cols)
          .withColumnsRenamed({f"_f_{c}": c for c in cols}))


def train_logreg(df: DataFrame, cols: Sequence[str], y: str = "y", split_col: str = "split", max_iter: int = 1000):
    """H6: L2 logistic regression with balanced class weights, fit on TRAIN.

    ``regParam = 1 / sum(weights)`` with no standardisation reproduces the C = 1 objective; with
    balanced weights the weight sum equals the row count.
    """
    from pyspark.ml.classification import LogisticRegression
    train = df.where(F.col(split_col) == TRAIN)
    c = train.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos")).first()
    n, pos = int(c["n"]), int(c["pos"] or 0)
    neg = n - pos
    w = F.when(F.col(y) == 1, F.lit(n / (2.0 * max(pos, 1)))).otherwise(F.lit(n / (2.0 * max(neg, 1))))
    data = _assembled(train.withColumn("_w", w).withColumn("_label", F.col(y).cast("double")), cols)
    lr = LogisticRegression(featuresCol="features", labelCol="_label", weightCol="_w", maxIter=max_iter,
                            regParam=1.0 / n, elasticNetParam=0.0, standardization=False, tol=1e-4)
    return lr.fit(data)


def logreg_gradient(df: DataFrame, cols: Sequence[str], coefficients: Sequence[float], intercept: float, y: str = "y",
                    split_col: str = "split") -> DataFrame:
    """H6's optimality: ``feature, at_zero, at_fit``, the partial derivatives of the weighted objective on TRAIN.

    The objective is the mean of the balanced log losses plus ``|b|^2 / (2 n)``; its derivatives vanish at the fit. One
    aggregate over the rows; the intercept's row is named ``(intercept)``.
    """
    train = df.where(F.col(split_col) == TRAIN)
    size = train.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos")).first()
    n, pos = int(size["n"]), int(size["pos"] or 0)
    label = F.col(y).cast("double")
    weight = F.when(F.col(y) == 1, F.lit(n / (2.0 * max(pos, 1)))).otherwise(F.lit(n / (2.0 * max(n - pos, 1))))
    z = F.lit(float(intercept))
    for c, b in zip(cols, coefficients, strict=True):
        z = z + F.lit(float(b)) * F.col(c).cast("double")
    terms = [*((c, F.col(c).cast("double"), float(b)) for c, b in zip(cols, coefficients, strict=True)), ("(intercept)", F.lit(1.0), 0.0)]
    aggs = []
    for i, (_, x, b) in enumerate(terms):
        aggs += [(F.sum(weight * (F.lit(0.5) - label) * x) / n).alias(f"zero{i}"),
                 ((F.sum(weight * (1 / (1 + F.exp(-z)) - label) * x) + b) / n).alias(f"fit{i}")]
    stack = ", ".join(f"'{name}', zero{i}, fit{i}" for i, (name, _, _) in enumerate(terms))
    return train.agg(*aggs).selectExpr(f"stack({len(terms)}, {stack}) as (feature, at_zero, at_fit)")


def staged_losses(model: BoostedTrees, df: DataFrame, cols: Sequence[str], y: str = "y", split_col: str = "split") -> list[float]:
    """H7's progress: the weighted mean log loss on TRAIN after each tree of a fitted model, one number per tree."""
    train, _, _, weight = _weighted_train(df, y, split_col)
    return boosting.mean_losses(model, train, cols, y, weight)


def train_gbt(df: DataFrame, cols: Sequence[str], y: str = "y", split_col: str = "split", trees: int = 400,
              depth: int = 6, rate: float = 0.05, seed: int = 42) -> BoostedTrees:
    """H7: boosted trees with positives weighted by negatives / max(positives, 1), fit on TRAIN."""
    train, n, pos, weight = _weighted_train(df, y, split_col)
    return boosting.fit(train, cols, y, n, pos, weight, trees, depth, rate, seed)


def _weighted_train(df: DataFrame, y: str, split_col: str) -> tuple[DataFrame, int, int, float]:
    """TRAIN, its rows, its positives and their weight."""
    train = df.where(F.col(split_col) == TRAIN)
    c = train.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("pos")).first()
    n, pos = int(c["n"]), int(c["pos"] or 0)
    return train, n, pos, (n - pos) / max(pos, 1)


def model_scores(model, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Positive-class probability of boosted trees or of a fitted Spark ML classifier as ``score``."""
    if isinstance(model, BoostedTrees):
        return boosting.scores(model, df, cols)
    from pyspark.ml.functions import vector_to_array
    out = model.transform(_assembled(df, cols))
    return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction",
                                                                             "probability", "prediction")
