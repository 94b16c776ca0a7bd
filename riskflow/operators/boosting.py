"""Boosted regression trees on binned features (H7): one job a level over rows that stay binned in Spark's cache.

The method and its numbers are those of Spark ML's ``GBTClassifier``: at most 32 bins a feature with candidates from a weighted
sample, log loss on labels -1 / +1, residuals as targets, variance gain, leaves of weighted means. Spark ML builds objects for
each row in each of its jobs, with a shuffle in each; here a partition is two arrays: codes (two bytes for a group of features
counted together) and margins. A level is one job: each task returns histograms of the nodes asked for, whose size does not
depend on the rows. Of two children only the smaller is counted, the other is the parent's less it. Splits of equal gain
go to the first feature and its lowest threshold, so the trees do not depend on how rows are dealt.

A table of at most ``LOCAL_ROWS`` rows is one partition and one job. Of others a partition has ``PART_ROWS`` rows at most, about 60 bytes each while a task works on it. The driver holds a level's histograms,
about 150 KB a partition, and the trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BINS = 32             # fixed values: Spark ML's defaults
SAMPLE_ROWS = 10_000      # rows that candidates are taken from, about
LOCAL_ROWS = 100_000      # up to so many rows are one partition
PART_ROWS = 4_000_000     # rows of a partition, about
CHECKPOINT_TREES = 25     # trees between checkpoints of the margins
JOINT_BINS = 1024         # features are counted together up to so many joint bins
SCORE_ROWS = 8192
TIE = 1e-12               # gains closer than this share of the node's sum are equal, and no gain
_TREE = "tree int, feature array<int>, threshold array<double>, leaf array<double>"


@dataclass
class BoostedTrees:
    """Complete trees of one depth: ``x[feature] <= threshold`` goes left, NaN goes right; ``leaf`` holds the bottom values times the rate."""

    depth: int
    feature: np.ndarray       # trees x (2 ** depth - 1), children of node i are 2 i + 1 and 2 i + 2
    threshold: np.ndarray
    leaf: np.ndarray          # trees x 2 ** depth

    def staged(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Margins of the rows of ``x`` after each tree."""
        flat, base = np.ascontiguousarray(x, dtype=np.float64).ravel(), np.arange(len(x)) * x.shape[1]
        margin = np.zeros(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.intp)
            for _ in range(self.depth):
                left = flat.take(base + feature.take(node)) <= threshold.take(node)
                node = 2 * node + 2 - left
            margin = margin + leaf.take(node - len(feature))
            yield margin

    def probability(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for i in range(0, len(x), SCORE_ROWS):
            *_, margin = self.staged(x[i:i + SCORE_ROWS])
            out[i:i + SCORE_ROWS] = 1.0 / (1.0 + np.exp(-2.0 * margin))
        return out


def candidates(values: np.ndarray, weights: np.ndarray, splits: int) -> np.ndarray:
    """At most ``splits`` thresholds: all midpoints of distinct values, or those nearest to equal steps of weight."""
    distinct, at = np.unique(values, return_inverse=True)
    if len(distinct) < 2:
        return np.empty(0)
    middle = (distinct[:-1] + distinct[1:]) / 2.0
    if len(middle) <= splits:
        return middle
    reached = np.cumsum(np.bincount(at.ravel(), weights))
    step = reached[-1] / (splits + 1)
    out, target = [], step
    for i in range(len(middle)):
        if abs(reached[i] - target) < abs(reached[i + 1] - target):
            out.append(middle[i])
            target += step
    return np.array(out)


def _columns(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """The first ``n`` columns as rows of doubles; null is NaN."""
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(n)])


def _packed(sizes: Sequence[int]) -> list[list[int]]:
    """Features in groups of at most JOINT_BINS joint bins."""
    groups: list[list[int]] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        for g in groups:
            if np.prod([sizes[i] for i in [*g, f]]) <= JOINT_BINS:
                g.append(f)
                break
        else:
            groups.append([f])
    return groups


class _Rows:
    """A partition's rows as joint codes, a row of ``codes`` for each group of features. Rows with label 1 come first."""

    def __init__(self, positives: int, codes: bytes, margin: bytes, sizes: Sequence[int]):
        self.sizes, self.groups, self.positives, self.held = sizes, _packed(sizes), positives, codes
        self.codes = np.frombuffer(codes, np.uint16).reshape(len(self.groups), -1)
        self.n = self.codes.shape[1]
        self.margin = np.frombuffer(margin) if margin else None

    def target(self, pos_weight: float) -> np.ndarray:
        """Weighted residuals: the labels before the first tree, then 4 y / (1 + exp(2 y margin))."""
        out = np.empty(self.n)
        for part, y, w in ((slice(self.positives), 1.0, pos_weight), (slice(self.positives, None), -1.0, 1.0)):
            at = out[part]
            if self.margin is None:
                at[:] = w * y
            else:
                np.multiply(self.margin[part], 2.0 * y, out=at)
                np.exp(at, out=at)
                at += 1.0
                np.divide(4.0 * y * w, at, out=at)
        return out

    def histogram(self, rows: np.ndarray | None, target: np.ndarray, counts: bool = True) -> np.ndarray:
        """Rows, rows of label 1 and the target's sum in each bin of each feature; without ``counts`` the sum only."""
        out = np.zeros((3, len(self.sizes), MAX_BINS))
        t, ones = (target, self.positives) if rows is None else (target.take(rows), int(np.searchsorted(rows, self.positives)))
        for g, code in zip(self.groups, self.codes, strict=True):
            shape = tuple(self.sizes[f] for f in g)
            x = (code if rows is None else code.take(rows)).astype(np.intp)
            size = int(np.prod(shape))
            numbers = [(0, np.bincount(x, minlength=size)), (1, np.bincount(x[:ones], minlength=size))] if counts else []
            for k, held in (*numbers, (2, np.bincount(x, t, minlength=size))):
                cube = held.reshape(shape)
                for axis, f in enumerate(g):
                    out[k, f, :shape[axis]] = cube.sum(axis=tuple(a for a in range(len(shape)) if a != axis))
        return out

    def node_rows(self, tree: _Tree, wanted: set[int]) -> Iterator[tuple[int, np.ndarray | None]]:
        """Row numbers, ascending, of the wanted nodes, none of which lies below another; ``None`` is all rows."""
        on_way = set()
        for at in wanted:
            while at not in on_way:
                on_way.add(at)
                at = max(0, (at - 1) // 2)
        group = {f: (k, i) for k, g in enumerate(self.groups) for i, f in enumerate(g)}
        todo: list[tuple] = [(0, None)]
        while todo:
            at, rows = todo.pop()
            if at in wanted:
                yield at, rows
                continue
            f, b = tree.splits[at]
            k, axis = group[f]
            shape = tuple(self.sizes[i] for i in self.groups[k])
            low = (np.indices(shape)[axis] <= b).ravel()
            left = low.take(self.codes[k] if rows is None else self.codes[k].take(rows))
            for child, here in ((2 * at + 1, left), (2 * at + 2, ~left)):
                if child in on_way:
                    todo.append((child, np.flatnonzero(here) if rows is None else rows[here]))


class _Tree:
    """A growing tree: the splits made, and the means of its ends."""

    def __init__(self):
        self.splits: dict[int, tuple[int, int]] = {}
        self.ends: dict[int, float] = {}

    def arrays(self, depth: int, thresholds: Sequence[np.ndarray], scale: float) -> tuple:
        feature, threshold, leaf = np.zeros(2 ** depth - 1, np.int32), np.full(2 ** depth - 1, np.inf), np.zeros(2 ** depth)
        for at, (f, b) in self.splits.items():
            feature[at], threshold[at] = f, thresholds[f][b]
        for at, value in self.ends.items():
            level = (at + 1).bit_length() - 1
            span = 2 ** (depth - level)
            first = (at + 1 - 2 ** level) * span
            leaf[first:first + span] = scale * value
        return feature, threshold, leaf


def best_splits(hist: np.ndarray, pos_weight: float) -> list[tuple | None]:
    """For each node's merged histogram: feature, bin, rows left and right, mean left and right; None if no split gains."""
    left = np.cumsum(hist, axis=-1)
    right = left[..., -1:] - left

    def parts(h):
        w = (h[:, 0] - h[:, 1]) + pos_weight * h[:, 1]
        some = (h[:, 0] > 0) & (w > 0)
        mean = np.divide(h[:, 2], w, out=np.zeros(w.shape), where=some)
        return some, mean, mean * h[:, 2]

    (some_l, mean_l, sum_l), (some_r, mean_r, sum_r), (_, _, whole) = parts(left), parts(right), parts(left[..., -1:])
    gain = np.where(some_l & some_r, sum_l + sum_r - whole, -np.inf).reshape(len(hist), -1)
    near = TIE * (sum_l + sum_r).reshape(len(hist), -1)
    out: list[tuple | None] = []
    for i in range(len(hist)):
        top = int(np.argmax(gain[i]))
        if not gain[i, top] > near[i, top]:
            out.append(None)
            continue
        f, b = divmod(int(np.argmax(gain[i] >= gain[i, top] - near[i, top])), hist.shape[-1])
        out.append((f, b, left[i, 0, f, b], right[i, 0, f, b], mean_l[i, f, b], mean_r[i, f, b]))
    return out


def _mean(hist: np.ndarray, pos_weight: float) -> float:
    n, ones, total = hist[:, 0].sum(axis=-1)
    w = (n - ones) + pos_weight * ones
    return float(total / w) if w > 0 else 0.0


def _grown(ask, depth: int, pos_weight: float) -> _Tree:
    """One tree; ``ask(tree, nodes)`` gives the nodes' histograms over all rows."""
    tree = _Tree()
    hist = ask(tree, [0])
    nodes = {0: _mean(hist[0], pos_weight)}
    for level in range(depth):
        below: dict[int, float] = {}
        kept = []
        for (at, mean), h, s in zip(nodes.items(), hist, best_splits(hist, pos_weight), strict=True):
            if s is None:
                tree.ends[at] = mean
                continue
            f, b, n_left, n_right, mean_left, mean_right = s
            tree.splits[at] = f, b
            below |= {2 * at + 1: mean_left, 2 * at + 2: mean_right}
            kept.append((at, h, n_left <= n_right))
        nodes = below
        if not nodes or level + 1 == depth:
            break
        less = ask(tree, [2 * at + (1 if first else 2) for at, _, first in kept])
        hist = np.stack([x for s, (_, h, first) in zip(less, kept, strict=True) for x in ((s, h - s) if first else (h - s, s))])
    tree.ends |= nodes
    return tree


def _count(part: tuple, tree: _Tree, nodes: list[int], sizes: Sequence[int], pos_weight: float, counts: bool = True) -> np.ndarray:
    """The nodes' histograms over a partition."""
    data, at = _Rows(*part, sizes), {x: i for i, x in enumerate(nodes)}
    target, out = data.target(pos_weight), np.zeros((len(nodes), 3, len(sizes), MAX_BINS))
    for x, found in data.node_rows(tree, set(nodes)):
        out[at[x]] = data.histogram(found, target, counts)
    return out


def _move(part: tuple, tree: _Tree, scale: float, sizes: Sequence[int]) -> tuple:
    """The partition with the tree's values added to the margins."""
    data = _Rows(*part, sizes)
    margin = np.zeros(data.n) if data.margin is None else data.margin.copy()
    for at, found in data.node_rows(tree, set(tree.ends)):
        margin[slice(None) if found is None else found] += scale * tree.ends[at]
    return data.positives, data.held, margin.tobytes()


def _counted(rows: RDD, tree: _Tree, nodes: list[int], sizes: Sequence[int], pos_weight: float, counts: bool = True) -> np.ndarray:
    """The nodes' histograms over all partitions: a job."""
    total = np.zeros((len(nodes), 3, len(sizes), MAX_BINS))
    for part in rows.map(lambda part: _count(part, tree, nodes, sizes, pos_weight, counts).tobytes()).collect():
        total += np.frombuffer(part).reshape(total.shape)
    return total


def _scale(m: int, rate: float) -> float:
    return 1.0 if m == 0 else rate      # as in Spark ML


def _alone(part: tuple, trees: int, depth: int, rate: float, pos_weight: float, sizes: Sequence[int]) -> Iterator[_Tree]:
    """The trees of a table that is a single partition: it has no one to exchange histograms with."""
    for m in range(trees):
        tree = _grown(lambda t, nodes, part=part: _count(part, t, nodes, sizes, pos_weight), depth, pos_weight)
        yield tree
        part = _move(part, tree, _scale(m, rate), sizes)


def fit(train: DataFrame, cols: Sequence[str], label: str, n: int, pos: int, pos_weight: float, trees: int, depth: int, rate: float,
        seed: int) -> BoostedTrees:
    """Trees of all rows of ``train`` (``n``, of which ``pos`` have label 1 and weight ``pos_weight``; the others weigh 1)."""
    from ..session import checkpoint_dir, remove_path, ship_package

    if n == 0:
        raise ValueError("no rows to train on")
    spark = train.sparkSession
    ship_package(spark)
    checkpoint_dir(spark)
    parts = 1 if n <= LOCAL_ROWS else max(spark.sparkContext.defaultParallelism, -(-n // PART_ROWS))
    block = max(64, min(4096, n // (8 * parts)))
    d = len(cols)
    data = train.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], F.col(label).cast("double").alias("y"))
    some = (data.sample(SAMPLE_ROWS / n, seed) if n > SAMPLE_ROWS else data).toArrow().combine_chunks().to_batches()
    x = np.concatenate([_columns(b, d + 1) for b in some]) if some else np.zeros((0, d + 1))
    weight = np.where(x[:, d] == 1, pos_weight, 1.0)
    thresholds = [candidates(x[:, i], weight, min(MAX_BINS, n) - 1) for i in range(d)]
    sizes = [len(t) + 1 for t in thresholds]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            v = _columns(batch, d + 1)
            if not np.isin(v[:, d], (0.0, 1.0)).all():
                raise ValueError("labels must be 0 or 1")
            if not np.isfinite(v).all():
                raise ValueError("features must not be null, NaN or infinite in training")
            b = np.column_stack([*(np.searchsorted(t, v[:, i]) for i, t in enumerate(thresholds)), v[:, d]]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([b[i:i + block].tobytes() for i in range(0, len(b), block)], pa.binary())], ["rows"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(r.as_buffer(), np.uint8) for batch in batches for r in batch.column(0)]
        if held:
            b = np.concatenate(held).reshape(-1, d + 1)
            b = np.concatenate([b[b[:, d] == 1], b[b[:, d] != 1]])
            codes = [np.ravel_multi_index(tuple(b[:, f].astype(np.intp) for f in g), tuple(sizes[f] for f in g)).astype(np.uint16) for g in _packed(sizes)]
            yield pa.RecordBatch.from_arrays([pa.array([int(b[:, d].sum(dtype=np.int64))], pa.int64()), pa.array([np.stack(codes).tobytes()], pa.binary())], ["positives", "codes"])

    dealt = data.mapInArrow(binned, "rows binary").repartition(parts).mapInArrow(joined, "positives long, codes binary")
    rows = dealt.rdd.map(lambda r: (r[0], bytes(r[1]), b""))
    if parts == 1:
        grown = rows.flatMap(lambda part: _alone(part, trees, depth, rate, pos_weight, sizes)).collect()
        return BoostedTrees(depth, *(np.array(x) for x in zip(*(t.arrays(depth, thresholds, _scale(m, rate)) for m, t in enumerate(grown)), strict=True)))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    found: list[tuple] = []
    old, saved, root = None, None, None

    def ask(tree: _Tree, nodes: list[int]) -> np.ndarray:
        nonlocal root
        again = nodes == [0] and root is not None
        hist = _counted(rows, tree, nodes, sizes, pos_weight, not again)
        if again:
            hist[0, :2] = root       # all rows: their numbers are the first tree's
        elif nodes == [0]:
            root = hist[0, :2].copy()
        if nodes == [0] and old is not None:
            old.unpersist()
        return hist

    try:
        for m in range(trees):
            scale = _scale(m, rate)
            tree = _grown(ask, depth, pos_weight)
            found.append(tree.arrays(depth, thresholds, scale))
            if rows.isCheckpointed():
                if saved:
                    remove_path(spark, saved)
                saved = rows.getCheckpointFile()
            if m + 1 < trees:
                old, rows = rows, rows.map(lambda part, tree=tree, scale=scale: _move(part, tree, scale, sizes)).persist(StorageLevel.MEMORY_AND_DISK)
                if (m + 1) % CHECKPOINT_TREES == 0:
                    rows.checkpoint()
    finally:
        rows.unpersist()
        if old is not None:
            old.unpersist()
        if saved:
            remove_path(spark, saved)
    return BoostedTrees(depth, *(np.array(x) for x in zip(*found, strict=True)))


def scores(model: BoostedTrees, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``df`` with the probability of label 1 as ``score``, in Arrow batches."""
    from pyspark.sql.functions import pandas_udf

    from ..session import ship_package
    ship_package(df.sparkSession)

    def run(*xs):
        import pandas as pd
        return pd.Series(model.probability(np.column_stack([x.to_numpy(dtype=np.float64, na_value=np.nan) for x in xs])))

    return df.withColumn("score", pandas_udf(run, "double")(*[F.col(c).cast("double") for c in cols]))


def mean_losses(model: BoostedTrees, train: DataFrame, cols: Sequence[str], label: str, pos_weight: float) -> list[float]:
    """The weighted mean log loss over all rows of ``train`` after each tree."""
    from ..session import ship_package
    ship_package(train.sparkSession)
    d, trees = len(cols), len(model.leaf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, weights = np.zeros(trees), 0.0
        for batch in batches:
            v = _columns(batch, d + 1)
            for i in range(0, len(v), SCORE_ROWS):
                part = v[i:i + SCORE_ROWS]
                y = 2.0 * part[:, d] - 1.0
                w = np.where(y > 0, pos_weight, 1.0)
                weights += w.sum()
                for m, margin in enumerate(model.staged(part[:, :d])):
                    loss[m] += w @ (2.0 * np.logaddexp(0.0, -2.0 * y * margin))
        yield pa.RecordBatch.from_pydict({"tree": pa.array(np.arange(trees), pa.int32()), "loss": pa.array(loss), "weight": pa.array(np.full(trees, weights))})

    data = train.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], F.col(label).cast("double").alias("y"))
    sums = data.mapInArrow(run, "tree int, loss double, weight double").groupBy("tree").agg((F.sum("loss") / F.sum("weight")).alias("mean"))
    return [r["mean"] for r in sorted(sums.collect(), key=lambda r: r["tree"])]
