"""Order-dependent building blocks that never put the whole table in one task.

* ``order_stats``      exact k-th smallest values (per group) by counting bisection
* ``exact_quantiles``  interpolated quantiles built on ``order_stats``
* ``running_totals``   cumulative sums along a global order, bucketed by range partitioning
* ``dense_index``      0-based position of each distinct key in sort order (B3)

Only small aggregates (counts, one row per bisection target and pass) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BISECT_BUCKETS = 1 << 16       # histogram buckets per bisection pass (<= 64k rows to the driver)
ROWS_PER_BUCKET = 1_000_000    # rows one running-total bucket may hold (one task's share)
MAX_RANGES = 100_000           # range partitions at most; beyond ~10^11 rows a range grows instead
OFFSETS_BROADCAST_MAX = 1_000_000  # running-total ranges whose offsets (two longs each) are broadcast
TARGETS_BROADCAST_MAX = 1_000_000  # open (key, rank) targets of group_kth sent to every task
LITERAL_GROUPS_MAX = 64        # grouped quantiles with more groups go through group_kth


def ranked(df: DataFrame, col: str) -> Column:
    """Rows that have a rank by ``col``: not null, and not NaN (which counts as missing)."""
    c = F.col(col)
    floating = isinstance(df.schema[col].dataType, (T.FloatType, T.DoubleType))
    return c.isNotNull() & ~F.isnan(c) if floating else c.isNotNull()


def group_stats(df: DataFrame, col: str) -> dict:
    """Count, min and max of the ranked values of ``col`` under the key ``None``; empty without any."""
    c = F.col(col)
    r = df.where(ranked(df, col)).agg(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).first()
    return {None: r} if r["n"] else {}


def bucket_of(v: Column, lo: Column, hi: Column, buckets: int) -> Column:
    """Monotone bucket of ``v`` in ``[lo, hi]`` (lo < hi) with lo and hi in different buckets.

    Infinite ends are split off first (-inf, the finite values, +inf). Differences that overflow are taken
    on halved values, so every pass of a bisection narrows its range, whatever the span.
    """
    inf = F.lit(float("inf"))
    d = [x.cast("double") for x in (v, lo, hi)]
    split = F.when(d[0] == -inf, 0).when(d[0] == inf, 2).otherwise(1)
    part = lambda x, y, dx, dy: F.coalesce(F.try_subtract(x, y).cast("double"), dx - dy)
    width = part(hi, lo, d[2], d[1])
    share = F.when(width == inf, (d[0] / 2 - d[1] / 2) / (d[2] / 2 - d[1] / 2)).otherwise(part(v, lo, d[0], d[1]) / width)
    inner = F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")
    return F.when((d[1] == -inf) | (d[2] == inf), split).otherwise(inner)


def order_stats(df: DataFrame, col: str, targets: list[tuple], by: str | None = None,
                stats: dict | None = None) -> dict:
    """Exact k-th smallest (1-based) values of a numeric column, per group, by counting bisection.

    ``targets`` holds ``(group, k)`` pairs (group ``None`` when ``by`` is None). Each pass keeps the
    rows inside the unresolved value ranges (pushed down to the scan) and counts them, with min
    and max, in at most ``BISECT_BUCKETS`` equal-width buckets per target; the next range is the
    tight [min, max] of the bucket holding rank k, found in Spark by a running count over the
    buckets. Map-side partial aggregation makes a hot key or value cost nothing extra; one row per
    target and pass reaches the driver. Suits a modest number of
    targets (groups x ranks); many groups use ``group_kth``.
    ``stats`` may pass in a ``group_stats`` result the caller already has (saves a scan). NaN counts as missing;
    infinities rank first and last.
    """
    c = F.col(col)
    if stats is None:
        if by is not None:
            raise ValueError("grouped targets need the groups' statistics")
        stats = group_stats(df, col)
    df = df.where(ranked(df, col))
    state, done = {}, {}
    for i, (g, k) in enumerate(targets):
        r = stats.get(g)
        if r is None or not 1 <= k <= r["n"]:
            raise ValueError(f"rank {k} outside 1..{r['n'] if r else 0} for group {g!r}")
        state[i] = [r["lo"], r["hi"], 0]
        if r["lo"] == r["hi"]:
            done[i] = r["lo"]
    while len(done) < len(targets):
        open_ = {i: s for i, s in state.items() if i not in done}
        tags, conds = [], []
        for i, (lo, hi, _) in open_.items():
            inside = c.between(F.lit(lo), F.lit(hi))
            if by:
                inside = inside & F.col(by).eqNullSafe(F.lit(targets[i][0]))
            conds.append(inside)
            kind = df.schema[col].dataType
            bucket = bucket_of(c, F.lit(lo).cast(kind), F.lit(hi).cast(kind), BISECT_BUCKETS)
            tags.append(F.when(inside, F.struct(F.lit(i).alias("i"), bucket.alias("b"), c.alias("v"))))
        cond = conds[0]
        for x in conds[1:]:
            cond = cond | x
        counts = (df.where(cond)
                    .select(F.explode(F.filter(F.array(*tags), lambda x: x.isNotNull())).alias("x"))
                    .groupBy(F.col("x.i").alias("i"), F.col("x.b").alias("b"))
                    .agg(F.count(F.lit(1)).alias("n"), F.min("x.v").alias("lo"), F.max("x.v").alias("hi")))
        # rank still needed inside each open range, as a literal map over the open targets (it is
        # evaluated on the bucket counts only, never on the scanned rows)
        kv = []
        for i, (_, _, below) in open_.items():
            kv += [F.lit(i), F.lit(int(targets[i][1] - below))]
        need_of = F.create_map(*kv)
        # the bucket holding that rank: running count over at most BISECT_BUCKETS rows per target
        cum = F.sum("n").over(Window.partitionBy("i").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        hits = (counts.withColumn("need", F.element_at(need_of, F.col("i"))).withColumn("_cum", cum)
                      .where((F.col("_cum") >= F.col("need")) & (F.col("_cum") - F.col("n") < F.col("need")))
                      .select("i", "lo", "hi", (F.col("_cum") - F.col("n")).alias("before"))
                      .collect())
        got = {int(r["i"]): r for r in hits}
        for i, (_, _, below) in open_.items():
            r = got.get(i)
            if r is None:  # pragma: no cover - counts always reach the rank
                raise RuntimeError("bisection lost the target rank")
            if (r["lo"], r["hi"]) == tuple(state[i][:2]):
                raise RuntimeError("a bisection pass did not narrow its range")
            state[i] = [r["lo"], r["hi"], below + int(r["before"])]
            if r["lo"] == r["hi"]:
                done[i] = r["lo"]
    return {targets[i]: done[i] for i in range(len(targets))}


def group_kth(df: DataFrame, key: str, value: str, ranks: DataFrame,
              buckets: int = BISECT_BUCKETS) -> DataFrame:
    """Exact k-th smallest ``value`` for every ``(key, k)`` row of ``ranks``, all targets at once.

    The counting bisection of ``order_stats`` with its targets kept as a table instead of literal
    expressions, for any number of keys: each pass joins the rows to the open targets (broadcast
    below ``TARGETS_BROADCAST_MAX`` counted targets, else a shuffle join with AQE skew handling),
    counts the rows inside each target's range into ``buckets`` equal-width buckets (map-side
    partial aggregation), and finds the rank's bucket with a running count over at most
    ``buckets`` rows per target. The target table is checkpointed after every pass; nothing
    reaches the driver but the count of open targets. Returns ``(key, k, kth)``.
    """
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    src = df.where(ranked(df, value)).select(key, F.col(value).alias("_v"))
    stats = src.groupBy(key).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    t = (ranks.select(key, F.col("k").cast("long").alias("k")).join(stats, key)
              .select(key, "k", "_lo", "_hi", F.lit(0).cast("long").alias("_below"))
              .checkpoint(eager=True))
    while True:
        open_ = t.where(F.col("_lo") < F.col("_hi"))
        n_open = open_.count()
        if n_open == 0:
            break
        side = F.broadcast(open_) if n_open <= TARGETS_BROADCAST_MAX else open_
        x = src.join(side, key).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        counts = (x.groupBy(key, "k", "_below", bucket_of(F.col("_v"), F.col("_lo"), F.col("_hi"), buckets).alias("_b"))
                   .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_blo"), F.max("_v").alias("_bhi")))
        need = F.col("k") - F.col("_below")
        cum = F.sum("_n").over(Window.partitionBy(key, "k").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        hit = (counts.withColumn("_cum", cum)
                     .where((F.col("_cum") >= need) & (F.col("_cum") - F.col("_n") < need))
                     .select(key, "k", F.col("_blo").alias("_lo"), F.col("_bhi").alias("_hi"),
                             (F.col("_below") + F.col("_cum") - F.col("_n")).alias("_below")))
        t = t.where(F.col("_lo") == F.col("_hi")).unionByName(hit).checkpoint(eager=True)
    return t.select(key, "k", F.col("_lo").alias("kth"))


def exact_kth(df: DataFrame, col: str, ks) -> tuple[int, list]:
    """Exact k-th smallest values of one column; ``ks`` may be a function of the count ``n``."""
    stats = group_stats(df, col)
    n = int(stats[None]["n"]) if None in stats else 0
    ks = ks(n) if callable(ks) else ks
    got = order_stats(df, col, [(None, k) for k in ks], stats=stats)
    return n, [got[(None, k)] for k in ks]


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The ``n`` first rows by ``order`` (numbers; ascending, nulls first, NaN last), without sorting the rows or passing them through one task.

    The n-th row's values are found column by column: the k-th smallest of the first column by counting bisection, then,
    among the rows that share it, the k-th of the next with what is left of n. A filter keeps what lies before or at that
    row. ``order`` must tell all rows apart; rows equal in all of it stay or go together.
    """
    if n <= 0:
        return df.limit(0)
    same, rest, before = F.lit(True), n, F.lit(False)
    for name in order:
        c = F.col(name)
        real = ranked(df, name)
        among = df.where(same)
        size = among.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(c.isNull(), 1)).alias("null"), F.count(F.when(real, 1)).alias("real")).first()
        if rest >= size["n"]:                                   # only before the first column is through: all rows there are
            return df.where(before | same)
        if rest <= size["null"]:
            at = c.isNull()
        elif rest <= size["null"] + size["real"]:
            value = order_stats(among, name, [(None, rest - size["null"])])[(None, rest - size["null"])]
            at = c.eqNullSafe(F.lit(value).cast(df.schema[name].dataType))
            lower = c.isNull() | (real & (c < F.lit(value)))
            before = before | (same & lower)
            rest -= among.where(lower).count()
        else:
            at = c.isNotNull() & ~real
            before = before | (same & (c.isNull() | real))
            rest -= size["null"] + size["real"]
        same = same & at
    return df.where(before | same)


def exact_quantiles(df: DataFrame, col: str, qs: list[float], by: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles (numpy 'linear', Spark ``percentile``) computed exactly.

    Returns one row per group: ``[by,] q_<i>`` columns (as DOUBLE) and ``n``. Up to
    ``LITERAL_GROUPS_MAX`` groups share one bisection with literal targets; with more groups the
    ranks, values and interpolation all stay in Spark (``group_kth``). The value (and group) column is
    cut out of the lineage once, so the passes do not repeat what leads to it.
    """
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    df = df.where(ranked(df, col)).select(*([by] if by else []), col).checkpoint()
    if by is not None:
        c = F.col(col)
        few = (df.groupBy(F.col(by).alias("g"))
                 .agg(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"))
                 .limit(LITERAL_GROUPS_MAX + 1).collect())
        if len(few) > LITERAL_GROUPS_MAX:
            return _grouped_quantiles(df, col, qs, by)
        stats = {r["g"]: r for r in few}
    else:
        stats = group_stats(df, col)
    ns = {g: int(r["n"]) for g, r in stats.items()}
    targets, plan = set(), {}
    for g, n in ns.items():
        for j, q in enumerate(qs):
            h = (n - 1) * q
            lo = math.floor(h)
            hi = min(lo + 1, n - 1)
            plan[(g, j)] = (lo, hi, h - lo)
            targets |= {(g, lo + 1), (g, hi + 1)}
    got = order_stats(df, col, sorted(targets, key=lambda t: (str(t[0]), t[1])), by, stats) if targets else {}
    rows = []
    for g, n in ns.items():
        vals = []
        for j in range(len(qs)):
            lo, hi, frac = plan[(g, j)]
            a, b = float(got[(g, lo + 1)]), float(got[(g, hi + 1)])
            vals.append(a if a == b or not frac else a + frac * (b - a))
        rows.append(((g,) if by else ()) + tuple(vals) + (n,))
    fields = ([T.StructField(by, df.schema[by].dataType)] if by else []) + \
        [T.StructField(f"q_{j}", T.DoubleType()) for j in range(len(qs))] + [T.StructField("n", T.LongType())]
    return df.sparkSession.createDataFrame(rows, T.StructType(fields))


def _grouped_quantiles(df: DataFrame, col: str, qs: list[float], by: str) -> DataFrame:
    n = df.groupBy(by).agg(F.count(col).alias("n"))
    plans = []
    for j, q in enumerate(qs):
        h = (F.col("n") - 1) * F.lit(float(q))
        lo = F.floor(h)
        plans.append(n.select(by, "n", F.lit(j).alias("_q"), (lo + 1).alias("_klo"),
                              (F.least(lo + 1, F.col("n") - 1) + 1).alias("_khi"), (h - lo).alias("_frac")))
    plan = reduce(DataFrame.unionByName, plans)
    ranks = plan.select(by, F.col("_klo").alias("k")).unionByName(plan.select(by, F.col("_khi").alias("k"))).distinct()
    kth = group_kth(df, by, col, ranks)
    a = kth.select(by, F.col("k").alias("_klo"), F.col("kth").cast("double").alias("_a"))
    b = kth.select(by, F.col("k").alias("_khi"), F.col("kth").cast("double").alias("_b"))
    between = F.when((F.col("_a") == F.col("_b")) | (F.col("_frac") == 0), F.col("_a")).otherwise(
        F.col("_a") + F.col("_frac") * (F.col("_b") - F.col("_a")))
    v = plan.join(a, [by, "_klo"]).join(b, [by, "_khi"]).select(by, "n", "_q", between.alias("_v"))
    out = v.groupBy(by, "n").agg(*[F.max(F.when(F.col("_q") == j, F.col("_v"))).alias(f"q_{j}") for j in range(len(qs))])
    return out.select(by, *[f"q_{j}" for j in range(len(qs))], F.col("n").cast("long").alias("n"))


def running_totals(df: DataFrame, order_col: str, sum_cols: list[str], descending: bool = False,
                   n_rows: int | None = None, rows_per_bucket: int = ROWS_PER_BUCKET,
                   prefix: str = "cum_") -> DataFrame:
    """Inclusive cumulative sums of ``sum_cols`` along ``order_col`` (ties: caller aggregates first).

    Rows are cut into value ranges of about ``rows_per_bucket`` rows by ``repartitionByRange``
    (Spark's range partitioner samples the bounds, at most 1M points, and binary-searches them per
    row); the partition id is the range index, checkpointed so every later pass sees the same
    ranges. Each range runs a partitioned window; the range totals (one row per range) become
    offsets with a window over that small table and are joined back, broadcast only below
    ``OFFSETS_BROADCAST_MAX`` ranges. No window runs over the fact rows without ``partitionBy``
    and nothing but the row count reaches the driver.
    """
    n = n_rows if n_rows is not None else df.count()
    buckets = min(max(1, math.ceil(n / rows_per_bucket)), MAX_RANGES)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    if buckets == 1:
        b = df.withColumn("_bucket", F.lit(0))
    else:
        from ..session import checkpoint_dir
        checkpoint_dir(df.sparkSession)
        b = (df.repartitionByRange(buckets, order)
               .withColumn("_bucket", F.spark_partition_id())
               .checkpoint(eager=True))
    w = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = b.select("*", *[F.sum(c).over(w).alias(f"_loc_{c}") for c in sum_cols])
    if buckets == 1:
        out = local
        for c in sum_cols:
            out = out.withColumnRenamed(f"_loc_{c}", f"{prefix}{c}")
        return out.drop("_bucket")
    totals = b.groupBy("_bucket").agg(*[F.sum(c).alias(c) for c in sum_cols])
    # one row per range (about rows / rows_per_bucket): an unpartitioned window is bounded here
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select("_bucket", *[F.sum(c).over(before).alias(f"_off_{c}") for c in sum_cols])
    side = F.broadcast(offs) if buckets <= OFFSETS_BROADCAST_MAX else offs
    out = local.join(side, "_bucket", "left")
    return out.select(*[c for c in df.columns],
                      *[(F.col(f"_loc_{c}") + F.coalesce(F.col(f"_off_{c}"), F.lit(0))).alias(f"{prefix}{c}")
                        for c in sum_cols])


def global_positions(df: DataFrame, order: Sequence[str], position: str, rows_per_range: int = ROWS_PER_BUCKET) -> DataFrame:
    """0-based position of every row in the global order of ``order`` (a total order; ties are cut at random).

    Rows go once through Spark's range partitioner and are sorted within their range; a row's number in its range
    plus the rows of the ranges before (one row per range, broadcast below ``OFFSETS_BROADCAST_MAX`` of them) is its
    position. No window runs over the rows and no second shuffle follows.
    """
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    ranges = min(max(1, math.ceil(df.count() / rows_per_range)), MAX_RANGES)
    placed = (df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
              .withColumn("_range", F.spark_partition_id())
              .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).checkpoint())
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    side = F.broadcast(offsets) if ranges <= OFFSETS_BROADCAST_MAX else offsets
    return placed.join(side, "_range").select(*df.columns, (F.col("_before") + F.col("_row")).cast("bigint").alias(position))


def dense_index(keys: DataFrame, key: str, index_col: str = "idx") -> DataFrame:
    """0-based contiguous id of each distinct key in ascending (byte-wise) key order.

    The distinct keys are cut out of the lineage once; their positions in the global order are the ids.
    """
    from ..session import checkpoint_dir
    checkpoint_dir(keys.sparkSession)
    d = keys.select(key).where(F.col(key).isNotNull()).distinct().checkpoint()
    return global_positions(d, [key], index_col)
