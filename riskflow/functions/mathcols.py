"""Numerically stable probability and loss expressions on logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(z) -> Column:
    """H1: 1 / (1 + exp(-z)), evaluated on the side that cannot overflow."""
    z = _c(z)
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def bce_with_logits(z, y) -> Column:
    """Per-row binary cross entropy on a logit: max(z,0) - z*y + log1p(exp(-|z|))."""
    z, y = _c(z), _c(y).cast("double")
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def focal_with_logits(z, y, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """I7 per-row focal term from the signed margin ``s = (2y - 1) z``: softplus(-s) * sigmoid(-s)^gamma.

    Rows of class 1 weigh ``alpha`` and rows of class 0 ``1 - alpha``; ``alpha < 0`` leaves them equal. Nothing is
    subtracted from one, so confident rows keep their digits.
    """
    label = _c(y).cast("double")
    against = (1.0 - 2.0 * label) * _c(z)
    softplus = F.greatest(against, F.lit(0.0)) + F.log1p(F.exp(-F.abs(against)))
    weight = F.when(label == 1.0, alpha).otherwise(1.0 - alpha) if alpha >= 0 else F.lit(1.0)
    return weight * softplus * F.pow(sigmoid(against), F.lit(float(gamma)))


def round_half_up(c, d: int) -> Column:
    """Round the shortest decimal form half away from zero (2.675 -> 2.68), returned as DOUBLE."""
    return F.round(_c(c).cast("decimal(38,10)"), d).cast("double")
