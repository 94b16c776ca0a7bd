"""Counts, means and centred co-moments of column pairs, merged pairwise.

Every task keeps one state for its rows: for each pair of columns the number of rows in which both are present, the means over
those rows, and the sums of products of deviations from them. States are merged with the usual update for two groups,
which never subtracts large sums, so a large mean does not cost digits. States of tasks are merged in groups by Spark, and
the groups' on the driver: ``MERGE_GROUPS`` rows at most for each class.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGE_GROUPS = 64
_STATE = "`by` long, n array<long>, mean array<double>, m2 array<double>, co array<double>"


@dataclass
class CoMoments:
    """d x d arrays; of entry (a, b): rows with both, the mean of a, the squared deviations of a, the products of deviations."""

    n: np.ndarray
    mean: np.ndarray
    m2: np.ndarray
    co: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> CoMoments:
        """Of a block of rows; NaN is missing."""
        here = ~np.isnan(x)
        m = here.astype(np.float64)
        rows = m.sum(0)
        shift = np.divide(np.where(here, x, 0.0).sum(0), rows, out=np.zeros(x.shape[1]), where=rows > 0)
        z = np.where(here, x - shift, 0.0)
        n = m.T @ m
        some = np.maximum(n, 1)
        a = z.T @ m
        return cls(n.astype(np.int64), np.where(n > 0, shift[:, None] + a / some, 0.0), (z * z).T @ m - a * a / some, z.T @ z - a * a.T / some)

    def merged(self, other: CoMoments) -> CoMoments:
        n = self.n + other.n
        share = np.divide(other.n, n, out=np.zeros(n.shape), where=n > 0)
        d = other.mean - self.mean
        both = self.n * share
        return CoMoments(n, self.mean + d * share, self.m2 + other.m2 + d * d * both, self.co + other.co + d * d.T * both)

    def covariance(self) -> np.ndarray:
        return np.divide(self.co, self.n - 1, out=np.full(self.n.shape, np.nan), where=self.n > 1)

    def correlation(self) -> np.ndarray:
        """NaN where a column does not vary (or has one row)."""
        scale = np.sqrt(self.m2 * self.m2.T)
        return np.divide(self.co, scale, out=np.full(self.n.shape, np.nan), where=scale > 0)


def _row(key: int | None, s: CoMoments) -> pa.RecordBatch:
    columns = [pa.array([key], pa.int64()), pa.array([s.n.ravel()], pa.list_(pa.int64())), *(pa.array([x.ravel()], pa.list_(pa.float64())) for x in (s.mean, s.m2, s.co))]
    return pa.RecordBatch.from_arrays(columns, ["by", "n", "mean", "m2", "co"])


def _states(batch, d: int) -> list[tuple[int | None, CoMoments]]:
    def square(name: str, i: int) -> np.ndarray:
        return np.array(batch.column(name)[i].as_py()).reshape(d, d)

    return [(batch.column("by")[i].as_py(), CoMoments(*(square(c, i) for c in ("n", "mean", "m2", "co")))) for i in range(batch.num_rows)]


def _merge(states: dict, found: list) -> None:
    for key, s in found:
        states[key] = states[key].merged(s) if key in states else s


def co_moments(df: DataFrame, cols: Sequence[str], by: str | None = None) -> dict[int | None, CoMoments]:
    """The state of all rows (key ``None``), or of each class ``by`` (few integers). Null and NaN count as missing."""
    from ..session import ship_package

    ship_package(df.sparkSession)
    d = len(cols)

    def count(batches):
        states: dict = {}
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(d)]) if batch.num_rows else np.zeros((0, d))
            keys = batch.column(0).to_pylist()
            for key in set(keys):
                _merge(states, [(key, CoMoments.of(x[[k == key for k in keys]] if by else x))])
        for key, s in states.items():
            yield _row(key, s)

    def gather(table: pa.Table) -> pa.Table:
        states: dict = {}
        for batch in table.to_batches():
            _merge(states, _states(batch, d))
        return pa.Table.from_batches([_row(k, s) for k, s in states.items()])

    key = (F.col(by).cast("long") if by else F.lit(None).cast("long")).alias("by")
    tasks = df.select(key, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).mapInArrow(count, _STATE)
    grouped = tasks.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS))).groupBy("g")
    merged = grouped.applyInArrow(gather, _STATE).toArrow()
    out: dict = {}
    for batch in merged.to_batches():
        _merge(out, _states(batch, d))
    return out
