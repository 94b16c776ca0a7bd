"""Class-conditioned triple PCA fitted on TRAIN rows only.

One pass over train computes, per class, the merged centred co-moments of all feature pairs; the "all" subset merges the two
classes' moments. Only these moments reach the driver, where the d x d covariance of each subset is diagonalised; the
projection of every row is a set of column expressions with literal loadings.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TRAIN
from .encode import apply_scaler, collect_scaler, fit_scaler
from .moments import CoMoments, co_moments

EPS = 1e-8          # fixed value: added to the train std before standardising
VARIANCE = 0.9      # fixed value: cumulative explained variance kept per subspace
SUBSETS = ("legit", "fraud", "all")


def standardise(df: DataFrame, cols: Sequence[str], split_col: str = "split") -> tuple[DataFrame, dict]:
    """(x - train mean) / (train population std + 1e-8), as DOUBLE columns ``xs_<col>``."""
    stats = collect_scaler(fit_scaler(df, cols, split_col, eps=EPS))
    x = df.select("*", *[F.col(c).cast("double").alias(f"xs_{c}") for c in cols])
    return apply_scaler(x, {f"xs_{c}": stats[c] for c in cols}, out_type="double"), stats


def subset_moments(df: DataFrame, cols: Sequence[str], y: str = "y", split_col: str = "split") -> dict:
    """per-subset (n, mean vector, sample covariance) from one pass over train."""
    found = co_moments(df.where(F.col(split_col) == TRAIN), [f"xs_{c}" for c in cols], y)
    parts = {"legit": [found[0]] if 0 in found else [], "fraud": [found[1]] if 1 in found else [], "all": list(found.values())}
    out = {}
    for tag, states in parts.items():
        if sum(int(s.n.max()) for s in states) < 2:
            raise ValueError(f"PCA subset {tag!r} needs at least 2 train rows")
        s = reduce(CoMoments.merged, states)
        out[tag] = (int(s.n.max()), np.diag(s.mean).copy(), s.covariance())
    return out


def components(cov: np.ndarray, variance: float = VARIANCE) -> np.ndarray:
    """eigenvectors (rows) of the smallest k with cumulative explained variance > ``variance``.

    The sign of each component is fixed so its largest-magnitude loading is positive.
    """
    return eigenpairs(cov, variance)[1]


def eigenpairs(cov: np.ndarray, variance: float = VARIANCE) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues, largest first, and ``components``."""
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, vecs = np.clip(vals[order], 0.0, None), vecs[:, order]
    ratio = np.cumsum(vals) / vals.sum() if vals.sum() > 0 else np.ones_like(vals)
    k = int(np.searchsorted(ratio, variance, side="right")) + 1
    k = min(k, len(vals))
    comp = vecs[:, :k].T
    for i in range(k):
        if comp[i, np.argmax(np.abs(comp[i]))] < 0:
            comp[i] = -comp[i]
    return vals, comp


def triple_pca(df: DataFrame, cols: Sequence[str], y: str = "y", split_col: str = "split",
               variance: float = VARIANCE) -> tuple[DataFrame, list[str]]:
    """project every row onto the legit, fraud and all-train subspaces; columns
    ``pca_{legit,fraud,all}_{i}`` (FLOAT), replacing the numeric block."""
    x, _ = standardise(df, cols, split_col)
    mom = subset_moments(x, cols, y, split_col)
    xs = [F.col(f"xs_{c}") for c in cols]
    exprs, names = [], []
    for tag in SUBSETS:
        _, mean, cov = mom[tag]
        comp = components(cov, variance)
        for i, row in enumerate(comp):
            z = F.lit(0.0)
            for j, w in enumerate(row):
                z = z + (xs[j] - F.lit(float(mean[j]))) * F.lit(float(w))
            names.append(f"pca_{tag}_{i}")
            exprs.append(z.cast("float").alias(names[-1]))
    out = x.select("*", *exprs).drop(*[f"xs_{c}" for c in cols])
    return out, names


def moments_table(df: DataFrame, cols: Sequence[str], y: str = "y", split_col: str = "split") -> DataFrame:
    """F2 as a table: (subset, f1, f2, cov) for every feature pair of every subset."""
    x, _ = standardise(df, cols, split_col)
    mom = subset_moments(x, cols, y, split_col)
    rows = [(tag, cols[i], cols[j], float(mom[tag][2][i, j]))
            for tag in SUBSETS for i in range(len(cols)) for j in range(i, len(cols))]
    return df.sparkSession.createDataFrame(rows, "subset string, f1 string, f2 string, cov double")


def eigen_check(df: DataFrame, cols: Sequence[str], y: str = "y", split_col: str = "split", variance: float = VARIANCE) -> DataFrame:
    """F3/F4 held against their definitions, one row per subset.

    ``p1, p2, p3``: sums of the eigenvalues, their squares and cubes (the traces of the covariance's powers). ``residual``: the
    largest entry of C v - lambda v. ``skew``: the largest entry of V V' - 1. ``enough``: the kept components explain more than
    ``variance``; ``least``: one fewer do not. ``projected``: every projection's sample variance over the subset's train
    rows, taken from the projected table, is its eigenvalue to four digits.
    """
    x, _ = standardise(df, cols, split_col)
    moments = subset_moments(x, cols, y, split_col)
    table, _ = triple_pca(df, cols, y, split_col, variance)
    pairs = {tag: eigenpairs(moments[tag][2], variance) for tag in SUBSETS}
    own = {"legit": F.col(y) == 0, "fraud": F.col(y) == 1, "all": F.lit(True)}
    spread = table.where(F.col(split_col) == TRAIN).agg(*[F.var_samp(F.when(own[tag], F.col(f"pca_{tag}_{i}").cast("double"))).alias(f"{tag}_{i}")
                                                          for tag, (_, comp) in pairs.items() for i in range(len(comp))]).first()
    rows = []
    for tag, (vals, comp) in pairs.items():
        cov, k = moments[tag][2], len(comp)
        share = np.cumsum(vals) / vals.sum()
        residual = np.abs(cov @ comp.T - comp.T * vals[:k]).max()
        skew = np.abs(comp @ comp.T - np.eye(k)).max()
        near = all(abs(spread[f"{tag}_{i}"] - vals[i]) <= 1e-4 * vals[i] for i in range(k))
        rows.append((tag, *(float((vals ** p).sum()) for p in (1, 2, 3)), float(residual), float(skew), bool(share[k - 1] > variance),
                     bool(k == 1 or share[k - 2] <= variance), near))
    return df.sparkSession.createDataFrame(rows, "subset string, p1 double, p2 double, p3 double, residual double, skew double, enough boolean, least boolean, projected boolean")
