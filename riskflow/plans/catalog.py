"""Registered queries: one per operator of SURVEY section 2, each paired with DuckDB SQL.

A query is ``fn(spark, sf_dir) -> DataFrame``; its oracle SQL (when the operator is expressible
in SQL) restates the same computation independently over the driver's views. Computed columns
carry the same alias on both sides, and doubles are rounded by the same rule (``present``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.encode import fit_scaler
from ..operators.features import with_user
from ..operators.scoring import class_weights, latest_per_card, score
from ..operators.split import split_bounds, split_summary, time_split
from ..operators.windows import pos_weight, seq_windows, split_windows, window_fullness
from ..schema import SEQ_LEN
from ..sources.adapters import orders_ties, tx_events
from . import oracle_sql as O
from .build import Processed, build_processed, feature_columns, features_table
from .present import present

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_MEMO: dict = {}


def _memo(spark: SparkSession, sf_dir: str, tag: str, make):
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, tag)
    if key not in _MEMO:
        _MEMO[key] = make()
    return _MEMO[key]


def processed(spark: SparkSession, sf_dir: str) -> Processed:
    """The processed table of ``tx_events`` (built once per session and scale)."""
    return _memo(spark, sf_dir, "processed", lambda: build_processed(tx_events(spark, sf_dir)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = processed(spark, sf_dir)
    return score(p.table).withColumn("score", F.col("prob"))


def with_sql(body: str, final: str) -> str:
    return "WITH " + body.lstrip().lstrip(",") + "\n" + final


# ---------------------------------------------------------------- step 1: scan, keys, features
RAW_COLS = ["cc_num", "unix_time", "amt", "lat", "long", "merch_lat", "merch_long",
            "category", "gender", "state", "is_fraud", "tie"]


@register("load_tx", with_sql(O.TX, "SELECT " + ", ".join(RAW_COLS) + " FROM tx"))
def q_load_tx(spark, sf):
    """A1/A2: raw transactions with the column allow-list applied at the scan."""
    return tx_events(spark, sf).select(*RAW_COLS)


@register("user_key", with_sql(O.TX, """SELECT tie,
  coalesce(cc_num, 'NA') || '|' || coalesce(gender, 'NA') || '|' || coalesce(state, 'NA') AS "user" FROM tx"""))
def q_user_key(spark, sf):
    """B1 on a composite key (card, segment, nation)."""
    tx = tx_events(spark, sf)
    return with_user(tx, ["cc_num", "gender", "state"]).select("tie", "user")


def _feat_query(cols: list[str], hot: bool = False):
    def fn(spark, sf):
        tx = tx_events(spark, sf)
        # chunks of a fixed share of the rows, so their number does not follow the table
        kw = {"hot_rows": 16, "chunk_rows": max(8, tx.count() // 400)} if hot else {}
        f = features_table(tx, **kw) if hot else processed(spark, sf).features
        return present(f.select("user", "unix_time", "tie", *cols), {c: 4 for c in cols})
    return fn


def _feat_sql(cols: list[str]) -> str:
    sel = ", ".join(f"{O.RND(c, 4)} AS {c}" if c != "hour" else f"{O.RND('\"hour\"', 4)} AS \"hour\"" for c in cols)
    return with_sql(O.FEAT, f'SELECT "user", unix_time, tie, {sel} FROM feat')


FEATURE_QUERIES = {
    "feat_amount": ["amt", "amt_log"],
    "feat_dt": ["dt"],
    "feat_roll_mean": ["amt_roll_mean"],
    "feat_count": ["amt_count"],
    "feat_geo": ["geo_dist"],
    "feat_time": ["hour", "dow"],
    "causal_features": O.NUMERIC,
}
for _name, _cols in FEATURE_QUERIES.items():
    register(_name, _feat_sql(_cols))(_feat_query(_cols))
# the same features through the hot-card path: every card above 16 rows is cut into chunks
register("causal_features_hot", _feat_sql(O.NUMERIC))(_feat_query(O.NUMERIC, hot=True))


# ---------------------------------------------------------------- step 2: split, encode, scale
@register("time_split", with_sql(O.FEAT + O.split_ctes("feat", "sp"), "SELECT tie, unix_time, split FROM sp"))
def q_time_split(spark, sf):
    """D1 on the card transactions."""
    return present(processed(spark, sf).features.select("tie", "unix_time", "split"))


ORDERS_T = """
ot AS (SELECT o_orderkey AS tie, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS unix_time FROM orders)"""


@register("time_split_ties", with_sql(ORDERS_T + O.split_ctes("ot", "osp"), "SELECT tie, unix_time, split FROM osp"))
def q_time_split_ties(spark, sf):
    """D1 on a tie-heavy time column (orders: many rows per date); ties go to the earlier split."""
    return present(time_split(orders_ties(spark, sf)).select("tie", "unix_time", "split"))


@register("split_summary", with_sql(O.SPLIT, f"""
SELECT s.split, s.split_name, CAST(coalesce(a.rows, 0) AS BIGINT) AS rows, {O.RND('coalesce(a.fraud_rate, 0.0)')} AS fraud_rate
FROM (VALUES (0, 'train'), (1, 'val'), (2, 'test')) s(split, split_name)
LEFT JOIN (SELECT split, count(*) AS rows, avg(CAST(is_fraud AS DOUBLE)) AS fraud_rate FROM sp GROUP BY split) a
ON a.split = s.split"""))
def q_split_summary(spark, sf):
    """D2."""
    return present(split_summary(processed(spark, sf).features))


@register("split_bounds", with_sql(O.SPLIT, """
SELECT split, min_t, max_t, coalesce(max_t < lead(min_t) OVER (ORDER BY split), true) AS ordered
FROM (SELECT split, min(unix_time) AS min_t, max(unix_time) AS max_t FROM sp GROUP BY split)"""))
def q_split_bounds(spark, sf):
    """D3: no-leak invariant per split."""
    return present(split_bounds(processed(spark, sf).features))


@register("category_map", with_sql(O.CODED, 'SELECT "column", value, CAST(code AS BIGINT) AS code FROM cmap'))
def q_category_map(spark, sf):
    """Train-only codes 1..K in code-point order."""
    return present(processed(spark, sf).category_map)


@register("category_codes", with_sql(O.CODED, "SELECT tie, split, " + ", ".join(
    f"CAST({c} AS BIGINT) AS {c}" for c in O.CODES) + " FROM coded"))
def q_category_codes(spark, sf):
    """Codes applied to every split, 0 when unseen in train."""
    return present(processed(spark, sf).table.select("tie", "split", *O.CODES))


@register("scaler_fit", with_sql(O.SCALED, "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, {O.RND(f'm_{c}')} AS mean, {O.RND(f's_{c}')} AS std FROM scl" for c in O.NUMERIC)))
def q_scaler_fit(spark, sf):
    """Train mean and population std (0 -> 1)."""
    return present(processed(spark, sf).scaler)


@register("scaler_apply", with_sql(O.SCALED, "SELECT tie, split, " + ", ".join(
    f"{O.RND(c if c != 'hour' else chr(34) + 'hour' + chr(34), 4)} AS {c}" for c in O.NUMERIC) + " FROM scaled"))
def q_scaler_apply(spark, sf):
    """Standardised numeric block on every split."""
    t = processed(spark, sf).table
    return present(t.select("tie", "split", *O.NUMERIC), {c: 4 for c in O.NUMERIC})


# ---------------------------------------------------------------- step 3: windows, scores, metrics
ALL_FEATS = O.NUMERIC + O.CODES


def _exploded(df: DataFrame) -> DataFrame:
    x = df.select("tie", F.posexplode("window").alias("step", "v"))
    return present(x.select("tie", F.col("step").cast("bigint").alias("step"),
                            *[F.col("v")[i].cast("double").alias(c) for i, c in enumerate(ALL_FEATS)]),
                   {c: 4 for c in ALL_FEATS})


def _windows_sql(where: str) -> str:
    pack = ", ".join(f'"{c}" := CAST("{c}" AS DOUBLE)' for c in ALL_FEATS)
    step = f"CASE WHEN s.step >= {SEQ_LEN} - len(l) THEN l[s.step - {SEQ_LEN} + len(l) + 1]"
    vals = ", ".join(O.RND(f'{step}."{c}" ELSE 0.0 END', 4) + f' AS "{c}"' for c in ALL_FEATS)
    return with_sql(O.SCALED + f""",
wl AS (SELECT tie, split, list(struct_pack({pack})) OVER (PARTITION BY "user" ORDER BY unix_time, tie
              ROWS BETWEEN {SEQ_LEN - 1} PRECEDING AND CURRENT ROW) AS l FROM scaled)""", f"""
SELECT t.tie, CAST(s.step AS BIGINT) AS step, {vals}
FROM wl t CROSS JOIN range(0, {SEQ_LEN}) s(step) WHERE {where}""")


@register("seq_windows", _windows_sql("true"))
def q_seq_windows(spark, sf):
    """G1: every row's causal window (L=32, left zero-padded), one output row per step."""
    p = processed(spark, sf)
    return _exploded(seq_windows(p.table, feature_columns(p), SEQ_LEN))


@register("val_windows", _windows_sql("t.split = 1"))
def q_val_windows(spark, sf):
    """Windows of VAL targets; context may reach back into train rows."""
    p = processed(spark, sf)
    return _exploded(split_windows(p.table, "val", feature_columns(p), SEQ_LEN))


@register("window_fullness", with_sql(O.FEAT, f"""
SELECT CAST(count(*) AS BIGINT) AS cards, {O.RND(f'avg(CASE WHEN n >= {SEQ_LEN} THEN 1.0 ELSE 0.0 END)')} AS card_share,
       {O.RND(f'sum(CASE WHEN n >= {SEQ_LEN} THEN n ELSE 0 END) / sum(n)')} AS tx_share
FROM (SELECT "user", count(*) AS n FROM feat GROUP BY "user")"""))
def q_window_fullness(spark, sf):
    """G6."""
    return present(window_fullness(processed(spark, sf).features, SEQ_LEN))


@register("pos_weight", with_sql(O.SPLIT, f"""
SELECT {O.RND('CASE WHEN sum(is_fraud) > 0 THEN (count(*) - sum(is_fraud)) / sum(is_fraud) ELSE 1.0 END')} AS pos_weight
FROM sp WHERE split = 1"""))
def q_pos_weight(spark, sf):
    """G4 over VAL targets."""
    return present(pos_weight(processed(spark, sf).features.where(F.col("split") == 1)))


@register("class_weights", with_sql(O.TX, f"""
SELECT n, pos, n - pos AS neg,
  {O.RND('CASE WHEN n - pos > 0 THEN n / (2.0 * (n - pos)) END')} AS w_neg,
  {O.RND('CASE WHEN pos > 0 THEN n / (2.0 * pos) END')} AS w_pos,
  {O.RND('(n - pos) / greatest(pos, 1)')} AS scale_pos_weight
FROM (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(is_fraud) AS BIGINT) AS pos FROM tx)"""))
def q_class_weights(spark, sf):
    """H8."""
    return present(class_weights(tx_events(spark, sf)))


@register("linear_scores", with_sql(O.SCORED, f"""
SELECT tie, split, {O.RND('logit')} AS logit, {O.RND('prob')} AS prob, prob >= 0.5 AS flag FROM scored"""))
def q_linear_scores(spark, sf):
    """H1/H2: every transaction scored from its own causal features."""
    return present(scored(spark, sf).select("tie", "split", "logit", "prob", "flag"))


@register("pr_auc", with_sql(O.SCORED + O.curve_ctes("scored", "split = 2"), "SELECT pr_auc FROM (" + O.summary_select("cur", None) + ")"))
def q_pr_auc(spark, sf):
    """I1 on TEST."""
    return present(M.pr_auc(scored(spark, sf).where("split = 2")))


@register("roc_auc", with_sql(O.SCORED + O.curve_ctes("scored", "split = 2"), "SELECT roc_auc FROM (" + O.summary_select("cur", None) + ")"))
def q_roc_auc(spark, sf):
    """I2 on TEST (ties count half)."""
    return present(M.roc_auc(scored(spark, sf).where("split = 2")))


@register("best_f1", with_sql(O.SCORED + O.curve_ctes("scored", "split = 1"), f"""
SELECT {O.RND(O.best_thr_sql('cur'))} AS threshold,
       {O.RND('coalesce((SELECT f1 FROM cur_f ORDER BY f1 DESC, threshold ASC LIMIT 1), 0.0)')} AS f1"""))
def q_best_f1(spark, sf):
    """I3 on VAL."""
    return present(M.best_f1(scored(spark, sf).where("split = 1")))


@register("metrics_at_threshold", with_sql(O.SCORED + O.curve_ctes("scored", "split = 2"), O.metrics_sql("cur", "0.5")))
def q_metrics_at_threshold(spark, sf):
    """I4 on TEST at 0.5."""
    return present(M.metrics_at(scored(spark, sf).where("split = 2"), 0.5))


@register("tune_and_report", with_sql(
    O.SCORED + O.curve_ctes("scored", "split = 1", "vcur") + O.curve_ctes("scored", "split = 2", "tcur"),
    O.metrics_sql("tcur", O.best_thr_sql("vcur"))))
def q_tune_and_report(spark, sf):
    """Threshold tuned on VAL, reported on TEST."""
    return present(M.tune_and_report(scored(spark, sf)))


@register("pr_curve", with_sql(O.SCORED + O.curve_ctes("scored", "split = 1"), f"""
SELECT {O.RND('threshold')} AS threshold, tp, fp, {O.RND('precision')} AS precision, {O.RND('recall')} AS recall,
       {O.RND('f1')} AS f1 FROM cur_f"""))
def q_pr_curve(spark, sf):
    """I6 on VAL."""
    c = M.pr_curve(scored(spark, sf).where("split = 1"))
    return present(c.select("threshold", "tp", "fp", "precision", "recall", "f1"))


@register("focal_loss", with_sql(O.SCORED, f"""
SELECT {O.RND('avg((0.25 * y + 0.75 * (1 - y)) * (greatest(logit, 0.0) - logit * y + ln(1 + exp(-abs(logit))))'
              ' * pow(1.0 - (p * y + (1.0 - p) * (1 - y)), 2.0))')} AS focal_loss
FROM (SELECT logit, CAST(y AS DOUBLE) AS y, prob AS p FROM scored)"""))
def q_focal_loss(spark, sf):
    """I7 with alpha 0.25, gamma 2 on every row's fixed-scorer logit."""
    return present(M.focal_loss(scored(spark, sf)))


@register("bce_loss", with_sql(O.SCORED, f"""
SELECT {O.RND('avg(greatest(logit, 0.0) - logit * CAST(y AS DOUBLE) + ln(1 + exp(-abs(logit))))')} AS bce_loss FROM scored"""))
def q_bce_loss(spark, sf):
    """I8 (bce)."""
    return present(M.bce_loss(scored(spark, sf)))


# further query groups register themselves on import
from . import catalog_report  # noqa: E402,F401
from . import catalog_serving  # noqa: E402,F401
from . import catalog_stream  # noqa: E402,F401
from . import catalog_models  # noqa: E402,F401
from . import catalog_more  # noqa: E402,F401
