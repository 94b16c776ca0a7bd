"""Per-card and per-segment lookups (J1-J8), computed for all requested keys at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.mathcols import round_half_up
from ..schema import SCORING_COLS, TEST
from ..session import checkpoint_dir
from .causal import CHUNK_ROWS, HOT_ROWS, causal_pass
from .ordering import group_kth, ranked

ORDER = ("unix_time", "tie")
TOP_CATEGORIES = 3
RECENT_K = 5
MAX_RECENT = 10_000                # rows of a card that one request may ask for; more is an error value
K_STEP = 16                        # requests are answered in classes of k: up to 16, 256, 4096, ...
HOT_DISTINCT = 2_000_000          # distinct values per key above which a median leaves the per-key window
HOT_KEYS_BROADCAST_MAX = 1_000_000


def card_col(df: DataFrame) -> Column:
    return F.col("cc_num").cast("string")


def group_median(df: DataFrame, key: str, value: str, out: str = "median",
                 hot_distinct: int = HOT_DISTINCT) -> DataFrame:
    """Exact per-key median (mean of the two middle values on even counts).

    Works on per-(key, value) counts, so a key costs one row per distinct value, not per row, and
    runs a running count per key over them. A key with more than ``hot_distinct`` distinct values
    (counted first) would make that window one large task; such keys get their two middle ranks
    from ``group_kth`` (distributed counting bisection) instead. No values are collected.
    """
    vc = df.where(ranked(df, value)).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    per = vc.groupBy(key).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d"))
    hot = per.where(F.col("_d") > hot_distinct).select(key, "_n")
    n_hot = hot.count()
    if n_hot:
        hot_side = F.broadcast(hot) if n_hot <= HOT_KEYS_BROADCAST_MAX else hot
        vc = vc.join(hot_side.select(key), key, "left_anti")
    w = Window.partitionBy(key).orderBy(value)
    cum = vc.select(key, value, F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_cum"),
                    F.sum("_c").over(Window.partitionBy(key)).alias("_n"))
    k1 = F.floor((F.col("_n") + 1) / 2)
    k2 = F.floor(F.col("_n") / 2) + 1
    agg = cum.groupBy(key).agg(F.min(F.when(F.col("_cum") >= k1, F.col(value))).alias("_x1"),
                               F.min(F.when(F.col("_cum") >= k2, F.col(value))).alias("_x2"))
    if n_hot:
        ranks = hot.select(key, F.floor((F.col("_n") + 1) / 2).alias("k"), F.lit(1).alias("_j")).unionByName(
            hot.select(key, (F.floor(F.col("_n") / 2) + 1).alias("k"), F.lit(2).alias("_j")))
        kth = group_kth(df.join(hot_side.select(key), key, "left_semi"), key, value, ranks.select(key, "k").distinct())
        mid = ranks.join(kth, [key, "k"]).groupBy(key).agg(
            F.max(F.when(F.col("_j") == 1, F.col("kth"))).alias("_x1"),
            F.max(F.when(F.col("_j") == 2, F.col("kth"))).alias("_x2"))
        agg = agg.unionByName(mid)
    return agg.select(key, ((F.col("_x1").cast("double") + F.col("_x2").cast("double")) / 2.0).alias(out))


def card_profile(tx: DataFrame, hot_distinct: int = HOT_DISTINCT) -> DataFrame:
    """Tx count, median / mean amount (2 dp), top-3 categories (an array), home state (mode, smallest on ties).

    One aggregation over the grouping sets (card, amount), (card, category) and (card, state) counts all three at once,
    partially before its shuffle, so a card costs one row per distinct value of each. Running counts and ranks over those
    rows give the median, the top categories and the state. Amounts of a card with more than ``hot_distinct`` distinct ones
    leave that window: their middle ranks come from ``group_kth``. A NaN amount counts as missing.
    """
    checkpoint_dir(tx.sparkSession)
    amount = F.col("amt").cast("double")
    x = tx.select(card_col(tx).alias("card_id"), F.when(~F.isnan(amount), amount).alias("amt"), "category", "state")
    sets = x.groupingSets([["card_id", "amt"], ["card_id", "category"], ["card_id", "state"]], "card_id", "amt", "category", "state")
    counted = sets.agg(F.count(F.lit(1)).alias("n"), F.grouping("amt").alias("_a"), F.grouping("category").alias("_c"))
    kind = F.when(F.col("_a") == 0, 0).when(F.col("_c") == 0, 1).otherwise(2)
    # cut out of the lineage: the check for hot cards and the profiles read the counts, not the rows
    counted = counted.select("card_id", kind.alias("kind"), "amt", F.coalesce("category", "state").alias("text"), "n").checkpoint()
    real_amount = (F.col("kind") == 0) & F.col("amt").isNotNull()
    hot = counted.where(real_amount).groupBy("card_id").agg(F.count(F.lit(1)).alias("_d"), F.sum("n").alias("_n")).where(F.col("_d") > hot_distinct)
    n_hot = hot.count()
    rest = counted
    if n_hot:
        side = F.broadcast(hot) if n_hot <= HOT_KEYS_BROADCAST_MAX else hot
        rest = counted.where(~real_amount).unionByName(counted.where(real_amount).join(side.select("card_id"), "card_id", "left_anti"))
    out = _profile_parts(rest)
    if n_hot:
        ranks = hot.select("card_id", F.explode(F.array(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1)).alias("k")).distinct()
        kth = group_kth(x.join(side.select("card_id"), "card_id", "left_semi"), "card_id", "amt", ranks)
        middle = kth.groupBy("card_id").agg(F.min("kth").alias("_x1"), F.max("kth").alias("_x2"))
        sums = counted.where(F.col("kind") == 0).join(side.select("card_id"), "card_id", "left_semi").groupBy("card_id").agg(
            F.sum("n").alias("_tx_count"), (F.sum(F.col("amt") * F.col("n")) / F.sum(F.when(real_amount, F.col("n")))).alias("_mean"))
        out = out.join(middle.join(sums, "card_id"), "card_id", "left")
        out = out.select("card_id", "tops", "home_state", *[F.coalesce(f"_{c}", c).alias(c) for c in ("x1", "x2", "tx_count", "mean")])
    return out.select(
        "card_id", F.col("tx_count").cast("bigint").alias("tx_count"), round_half_up((F.col("x1") + F.col("x2")) / 2.0, 2).alias("median_amt"),
        round_half_up("mean", 2).alias("avg_amt"), F.transform("tops", lambda v: v["text"]).alias("top_categories"), "home_state")


def _profile_parts(counted: DataFrame) -> DataFrame:
    """Per card of ``(card_id, kind, amt, text, n)`` rows, one per distinct value: sums, middle amounts, top texts."""
    # amounts in their order and texts by count; nulls last, where neither a middle nor a rank is looked for
    one = Window.partitionBy("card_id", "kind")
    along = one.orderBy(F.col("amt").asc_nulls_last(), F.col("text").isNull(), F.desc("n"), F.asc("text"))
    amount = (F.col("kind") == 0) & F.col("amt").isNotNull()
    real = F.when(amount, F.col("n")).otherwise(0)
    x = counted.repartition("card_id").select(
        "*", F.row_number().over(along).alias("rank"), F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum(real).over(one).alias("real"))
    low, high = F.floor((F.col("real") + 1) / 2), F.floor(F.col("real") / 2) + 1
    named = F.col("text").isNotNull()
    top = F.when((F.col("kind") == 1) & named & (F.col("rank") <= TOP_CATEGORIES), F.struct("rank", "text"))
    return x.groupBy("card_id").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("tx_count"),
        (F.sum(F.when(amount, F.col("amt") * F.col("n"))) / F.max(F.when(amount, F.col("real")))).alias("mean"),
        F.min(F.when(amount & (F.col("upto") >= low), F.col("amt"))).alias("x1"), F.min(F.when(amount & (F.col("upto") >= high), F.col("amt"))).alias("x2"),
        F.array_sort(F.collect_list(top)).alias("tops"), F.max(F.when((F.col("kind") == 2) & named & (F.col("rank") == 1), F.col("text"))).alias("home_state"))


def profile_requests(requests: DataFrame, profiles: DataFrame, key: str = "card_id") -> DataFrame:
    """Profile for each requested id; unknown ids get zeros, an empty array and a null state."""
    r = requests.select(F.col(key).cast("string").alias("card_id")).distinct()
    j = r.join(profiles, "card_id", "left")
    return j.select("card_id",
                    F.coalesce("tx_count", F.lit(0)).cast("bigint").alias("tx_count"),
                    F.coalesce("median_amt", F.lit(0.0)).alias("median_amt"),
                    F.coalesce("avg_amt", F.lit(0.0)).alias("avg_amt"),
                    F.coalesce("top_categories", F.array().cast("array<string>")).alias("top_categories"),
                    "home_state")


def card_ids(tx: DataFrame, limit: int = 100) -> DataFrame:
    """Known card ids in order of first appearance; ``limit <= 0`` returns all of them.

    The first row per card is a ``min`` of (time, tie) — partial aggregation, skew-safe — and the
    limit is a distributed top-k (TakeOrderedAndProject).
    """
    first = tx.groupBy(card_col(tx).alias("card_id")).agg(F.min(F.struct(*ORDER)).alias("_f"))
    out = first.select("card_id", F.col("_f.unix_time").alias("first_unix_time"), F.col("_f.tie").alias("first_tie"))
    ordered = out.orderBy("first_unix_time", "first_tie")
    return ordered.limit(limit) if limit and limit > 0 else ordered


def raw_history(tx: DataFrame, cards: DataFrame | None = None, hot_rows: int = HOT_ROWS,
                chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Label-free history of the requested cards (all when ``cards`` is None), with each row's
    0-based position in its card (oldest first). Unknown ids simply match nothing.
    """
    t = tx.withColumn("card_id", card_col(tx))
    if cards is not None:
        t = t.join(cards.select(F.col("card_id").cast("string")).distinct(), "card_id", "left_semi")
    cols = [c for c in SCORING_COLS if c in t.columns]
    x = causal_pass(t.select("card_id", *cols, "tie"), "card_id", ORDER, hot_rows=hot_rows, chunk_rows=chunk_rows)
    return x.select("card_id", F.col("_prior_n").alias("position"), *[c for c in cols if c != "cc_num"], "tie")


def recent_transactions(tx: DataFrame, k: int = RECENT_K) -> DataFrame:
    """Each card's last ``k`` rows, numbered oldest first (1..k), amounts to 2 dp; k <= 0 -> empty.

    ``row_number() <= k`` over a descending order becomes a WindowGroupLimit: every task keeps at
    most k rows per card before the shuffle, so a hot card costs k rows per task.
    """
    t = tx.withColumn("card_id", card_col(tx))
    if k <= 0:
        return t.select("card_id", "unix_time", "amt", "category", "state", F.lit(0).alias("k")).limit(0)
    w = Window.partitionBy("card_id").orderBy(*[F.col(c).desc() for c in ORDER])
    last = t.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    cnt = F.count(F.lit(1)).over(Window.partitionBy("card_id"))
    return last.select("card_id", "unix_time", round_half_up("amt", 2).alias("amt"), "category", "state",
                       (cnt - F.col("_r") + 1).cast("bigint").alias("k"))


def segment_rates(tx: DataFrame) -> DataFrame:
    """Fraud rate per (category, state), 4 dp; rows with a null key are excluded."""
    t = tx.where(F.col("category").isNotNull() & F.col("state").isNotNull())
    return t.groupBy("category", "state").agg(
        round_half_up(F.avg(F.col("is_fraud").cast("double")), 4).alias("fraud_rate"),
        F.count(F.lit(1)).alias("n"))


def segment_lookup(requests: DataFrame, rates: DataFrame) -> DataFrame:
    """J6 lookup: unseen segments give 0.0. The rate table is per segment (small, broadcast by size)."""
    r = rates.select("category", "state", "fraud_rate")
    return requests.join(r, ["category", "state"], "left").withColumn(
        "fraud_rate", F.coalesce("fraud_rate", F.lit(0.0)))


def test_pool(tx_split: DataFrame, fraud_only: bool = False) -> DataFrame:
    """J7 pool: TEST-split rows (optionally fraud only)."""
    p = tx_split.where(F.col("split") == TEST)
    return p.where(F.col("is_fraud") == 1) if fraud_only else p


def sample_test(tx_split: DataFrame, n: int = 1, seed: int = 0, fraud_only: bool = False) -> DataFrame:
    """Repeatable draw of ``n`` TEST rows: order by a seeded hash of ``tie``, keep n.

    Empty pools raise, as the reference does. The limit is the feature (a sampling operator).
    """
    pool = test_pool(tx_split, fraud_only)
    if pool.limit(1).count() == 0:
        raise ValueError("no TEST-split transactions match the filter")
    return pool.orderBy(F.md5(F.concat_ws("|", F.col("tie").cast("string"), F.lit(str(seed)))), F.col("tie")).limit(n)


def validate_requests(req: DataFrame) -> DataFrame:
    """An ``error`` value per lookup request instead of a failure.

    Columns used when present: card_id, k, category, state. Rows with an error skip the lookups. The texts are fixed
    values but for the one on ``MAX_RECENT``, a bound of ours.
    """
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    err = F.lit(None).cast("string")
    checks = []
    if "card_id" in req.columns:
        checks.append((blank("card_id"), "card_id must be a non-empty string."))
    if "k" in req.columns:
        checks.append((F.col("k").isNull() | (F.col("k") <= 0), "k must be a positive integer."))
        checks.append((F.col("k") > MAX_RECENT, f"k must be at most {MAX_RECENT}."))
    if "category" in req.columns:
        checks.append((blank("category"), "category must be a non-empty string."))
    if "state" in req.columns:
        checks.append((blank("state"), "state must be a non-empty string."))
    for cond, msg in reversed(checks):
        err = F.when(cond, F.lit(msg)).otherwise(err)
    return req.withColumn("error", err)


def recent_arrays(tx: DataFrame, asked: DataFrame, *fields: str, k: int | None = None) -> DataFrame:
    """``card_id, recent``: each asked card's last ``k`` rows (``asked``: one row per card, with its k or all with ``k``), oldest first.

    Cards are taken in classes of k, so that every task keeps at most ``K_STEP`` times the rows that a card was asked
    for, whatever the largest k. A row is a struct of its number (1..k), ``unix_time``, ``amt`` (2 dp) and ``fields``.
    """
    if k is not None:
        w = Window.partitionBy("card_id").orderBy(*[F.col(c).desc() for c in ORDER])
        rows = tx.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= min(max(k, 0), MAX_RECENT))
        return _recent_rows(rows, fields)
    classes = [r[0] for r in asked.select(F.ceil(F.log(float(K_STEP), F.greatest("k", F.lit(2)))).alias("c")).distinct().orderBy("c").collect()]
    w = Window.partitionBy("card_id").orderBy(*[F.col(c).desc() for c in ORDER])
    parts = []
    for c in classes:
        of_class = asked.where(F.ceil(F.log(float(K_STEP), F.greatest("k", F.lit(2)))) == c)
        own = tx.join(of_class.select("card_id"), "card_id", "left_semi")
        last = own.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= min(K_STEP ** int(c), MAX_RECENT))
        parts.append(last.join(of_class, "card_id").where(F.col("_r") <= F.col("k")))
    if not parts:
        parts = [tx.limit(0).withColumn("_r", F.lit(0)).withColumn("k", F.lit(0))]
    return _recent_rows(reduce(DataFrame.unionByName, [p.select("card_id", *ORDER, "amt", *fields) for p in parts]), fields)


def _recent_rows(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    item = F.struct(*ORDER, "amt", *fields)
    held = rows.groupBy("card_id").agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    return held.select("card_id", F.transform("_rows", lambda v, i: F.struct(
        (i + 1).cast("long").alias("k"), v["unix_time"].alias("unix_time"), round_half_up(v["amt"], 2).alias("amt"), *[v[f].alias(f) for f in fields])).alias("recent"))


def answer_requests(req: DataFrame, tx: DataFrame) -> DataFrame:
    """J8 end to end: requests ``(card_id, k, category, state)`` with their ``error`` or the three lookups' answers.

    Good rows get the profile columns, ``recent`` (the card's last ``k`` rows, oldest first) and ``fraud_rate``; of
    the bad ones these are null. The history is cut to the requested cards before it is aggregated; a card's rows are
    collected once, as many as its largest request asks for.
    """
    checked = validate_requests(req)
    good = checked.where(F.col("error").isNull())
    asked = good.groupBy("card_id").agg(F.max("k").cast("long").alias("k"))
    own = tx.withColumn("card_id", card_col(tx)).join(asked.select("card_id"), "card_id", "left_semi")
    rows = recent_arrays(own, asked, "category", "state").withColumnRenamed("recent", "_last")
    out = (good.join(profile_requests(asked, card_profile(own)), "card_id", "left").join(rows, "card_id", "left"))
    out = segment_lookup(out, segment_rates(tx))
    empty = F.array().cast(rows.schema["_last"].dataType)
    held = F.coalesce(F.col("_last"), empty)
    k = F.col("k").cast("int")
    tail = F.slice(held, F.greatest(F.size(held) - k + 1, F.lit(1)), k)
    first = F.greatest(F.size(held) - k, F.lit(0))
    # a smaller request of the card gets the end of its rows, numbered from 1
    out = out.withColumn("recent", F.transform(tail, lambda v: v.withField("k", v["k"] - first))).drop("_last")
    bad = checked.where(F.col("error").isNotNull())
    return out.unionByName(bad, allowMissingColumns=True)
