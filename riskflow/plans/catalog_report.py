"""Registered lookup (J), ordering (B3/B4) and exploratory report (M) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups as J
from ..operators import report as R
from ..operators.ordering import dense_index, first_rows, global_positions
from ..schema import SCORING_COLS
from ..sources.adapters import tx_events
from ..sources.tables import read_table
from . import oracle_sql as O
from .catalog import processed, register, with_sql
from .present import present

RND = O.RND
HIST_CARD_BINS = 40     # fixed values: notebook histogram bin counts
HIST_AMT_BINS = 60

CARD_T = O.TX + """,
t AS (SELECT CAST(cc_num AS VARCHAR) AS card_id, * FROM tx)"""

PROFILE = CARD_T + """,
pbase AS (SELECT card_id, count(*) AS tx_count, avg(amt) AS avg_amt, median(amt) AS median_amt FROM t GROUP BY card_id),
pcat AS (SELECT card_id, category, count(*) AS n FROM t WHERE category IS NOT NULL GROUP BY card_id, category),
ptop AS (
  SELECT card_id, CAST(to_json(list(category ORDER BY r)) AS VARCHAR) AS top_categories
  FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY n DESC, category ASC) AS r FROM pcat)
  WHERE r <= 3 GROUP BY card_id),
pst AS (
  SELECT card_id, state AS home_state FROM (
    SELECT card_id, state, row_number() OVER (PARTITION BY card_id ORDER BY count(*) DESC, state ASC) AS r
    FROM t WHERE state IS NOT NULL GROUP BY card_id, state) WHERE r = 1),
profile AS (
  SELECT b.card_id, CAST(b.tx_count AS BIGINT) AS tx_count, """ + RND("b.median_amt", 2) + """ AS median_amt,
         """ + RND("b.avg_amt", 2) + """ AS avg_amt, coalesce(p.top_categories, '[]') AS top_categories, s.home_state
  FROM pbase b LEFT JOIN ptop p ON p.card_id = b.card_id LEFT JOIN pst s ON s.card_id = b.card_id)"""


@register("card_profile", with_sql(PROFILE, "SELECT * FROM profile"))
def q_card_profile(spark, sf):
    """J1 for every card."""
    return present(top_as_text(J.card_profile(tx_events(spark, sf))))


def top_as_text(df):
    """The array of top categories as JSON text, which both engines write alike."""
    return df.withColumn("top_categories", F.to_json("top_categories"))


@register("card_profile_requests", with_sql(PROFILE, """
SELECT r.card_id, coalesce(p.tx_count, 0) AS tx_count, coalesce(p.median_amt, 0.0) AS median_amt,
       coalesce(p.avg_amt, 0.0) AS avg_amt, coalesce(p.top_categories, '[]') AS top_categories, p.home_state
FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS card_id FROM customer) r
LEFT JOIN profile p ON p.card_id = r.card_id"""))
def q_card_profile_requests(spark, sf):
    """Profiles requested for every customer key; customers without transactions are unknown cards."""
    req = read_table(spark, sf, "customer", ["c_custkey"]).select(F.col("c_custkey").cast("string").alias("card_id"))
    return present(top_as_text(J.profile_requests(req, J.card_profile(tx_events(spark, sf)))))


@register("card_ids", with_sql(CARD_T, """
SELECT card_id, unix_time AS first_unix_time, tie AS first_tie FROM (
  SELECT card_id, unix_time, tie, row_number() OVER (PARTITION BY card_id ORDER BY unix_time, tie) AS r FROM t)
WHERE r = 1 ORDER BY unix_time, tie LIMIT 100"""))
def q_card_ids(spark, sf):
    """First 100 card ids by first appearance (the API's list default)."""
    return present(J.card_ids(tx_events(spark, sf), 100))


HIST_COLS = [c for c in SCORING_COLS if c != "cc_num"]


@register("raw_history", with_sql(CARD_T, "SELECT card_id, CAST(row_number() OVER (PARTITION BY card_id ORDER BY unix_time, tie) - 1 AS BIGINT) AS position, "
                          + ", ".join(HIST_COLS) + ", tie FROM t"))
def q_raw_history(spark, sf):
    """Label-free history of every card with its position (oldest first)."""
    return present(J.raw_history(tx_events(spark, sf)))


@register("recent_k", with_sql(CARD_T, f"""
SELECT card_id, unix_time, {RND('amt', 2)} AS amt, category, state, CAST(cnt - r + 1 AS BIGINT) AS k FROM (
  SELECT *, count(*) OVER (PARTITION BY card_id) AS cnt FROM (
    SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY unix_time DESC, tie DESC) AS r FROM t)
  WHERE r <= 5)"""))
def q_recent_k(spark, sf):
    """Last 5 transactions of every card, numbered oldest first."""
    return present(J.recent_transactions(tx_events(spark, sf), 5))


@register("segment_rate", with_sql(O.TX, f"""
SELECT category, state, {RND('avg(CAST(is_fraud AS DOUBLE))', 4)} AS fraud_rate, count(*) AS n
FROM tx WHERE category IS NOT NULL AND state IS NOT NULL GROUP BY category, state"""))
def q_segment_rate(spark, sf):
    """J6."""
    return present(J.segment_rates(tx_events(spark, sf)))


@register("segment_lookup", with_sql(O.TX, f"""
SELECT r.tie, r.category, r.state, coalesce(s.fraud_rate, 0.0) AS fraud_rate FROM
  (SELECT tie, category, CASE WHEN gender = 'BUILDING' THEN 'NO_SUCH_STATE' ELSE state END AS state FROM tx) r
LEFT JOIN (SELECT category, state, {RND('avg(CAST(is_fraud AS DOUBLE))', 4)} AS fraud_rate FROM tx
           WHERE category IS NOT NULL AND state IS NOT NULL GROUP BY category, state) s
ON s.category = r.category AND s.state = r.state"""))
def q_segment_lookup(spark, sf):
    """J6 lookup per transaction; rows of one segment ask for a state that never occurs (-> 0.0)."""
    tx = tx_events(spark, sf)
    req = tx.select("tie", "category", F.when(F.col("gender") == "BUILDING", F.lit("NO_SUCH_STATE"))
                    .otherwise(F.col("state")).alias("state"))
    return present(J.segment_lookup(req, J.segment_rates(tx)).select("tie", "category", "state", "fraud_rate"))


@register("card_index", with_sql(O.FEAT, """
SELECT "user", CAST(row_number() OVER (ORDER BY "user") - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT "user" FROM base)"""))
def q_card_index(spark, sf):
    """Contiguous 0-based card id in lexicographic key order, no single-partition window."""
    return present(dense_index(processed(spark, sf).features.select("user"), "user"))


FIREHOSE_SQL = with_sql(O.TX, "SELECT CAST(row_number() OVER (ORDER BY unix_time, tie) - 1 AS BIGINT) AS position, "
                        "cc_num, " + ", ".join(HIST_COLS) + ", tie FROM tx")


@register("firehose", FIREHOSE_SQL)
def q_firehose(spark, sf):
    """Every transaction in global (time, tie) order as a position, label-free."""
    tx = tx_events(spark, sf).select("cc_num", *HIST_COLS, "tie")
    return present(global_positions(tx, ["unix_time", "tie"], "position"))


@register("firehose_ranges", FIREHOSE_SQL)
def q_firehose_ranges(spark, sf):
    """B4 cut into about 20 ranges at every size, so offsets between ranges always count."""
    tx = tx_events(spark, sf).select("cc_num", *HIST_COLS, "tie")
    return present(global_positions(tx, ["unix_time", "tie"], "position", rows_per_range=max(1, tx.count() // 20)))


@register("firehose_head", with_sql(O.TX, "SELECT cc_num, " + ", ".join(HIST_COLS) + ", tie FROM tx ORDER BY unix_time, tie LIMIT 1000"))
def q_firehose_head(spark, sf):
    """B4 with a first-N limit (1000): a distributed top-k, not a global sort."""
    tx = tx_events(spark, sf).select("cc_num", *HIST_COLS, "tie")
    return present(tx.orderBy("unix_time", "tie").limit(1000))


@register("firehose_first", with_sql(O.TX, "SELECT cc_num, " + ", ".join(HIST_COLS) + ", tie FROM tx ORDER BY unix_time, tie LIMIT (SELECT count(*) // 2 FROM tx)"))
def q_firehose_first(spark, sf):
    """B4/A7 with a first-N limit of half the table: the N-th (time, tie) by bisection, then a filter; no task holds N rows."""
    tx = tx_events(spark, sf).select("cc_num", *HIST_COLS, "tie")
    return present(first_rows(tx, ["unix_time", "tie"], tx.count() // 2))


# ---------------------------------------------------------------- report
@register("overview", with_sql(O.TX, f"""
SELECT count(*) AS rows, count(DISTINCT cc_num) AS cards, {RND('avg(CAST(is_fraud AS DOUBLE))')} AS fraud_rate FROM tx"""))
def q_overview(spark, sf):
    """M1."""
    return present(R.overview(tx_events(spark, sf)))


@register("class_counts", with_sql(O.TX, "SELECT CAST(is_fraud AS BIGINT) AS is_fraud, count(*) AS n FROM tx GROUP BY is_fraud"))
def q_class_counts(spark, sf):
    """M2."""
    return present(R.class_counts(tx_events(spark, sf)))


@register("monthly_drift", with_sql(O.TX, f"""
SELECT strftime(make_timestamp(unix_time * 1000000), '%Y-%m') AS month, count(*) AS rows,
       {RND('avg(CAST(is_fraud AS DOUBLE))')} AS fraud_rate FROM tx GROUP BY 1"""))
def q_monthly_drift(spark, sf):
    """M3."""
    return present(R.monthly_drift(tx_events(spark, sf)))


@register("cut_lines", with_sql(O.TX, f"""
SELECT {RND('quantile_cont(unix_time, 0.7)')} AS t_q70, {RND('quantile_cont(unix_time, 0.8)')} AS t_q80 FROM tx"""))
def q_cut_lines(spark, sf):
    """M4: interpolated 70 % / 80 % time lines (differs from D1's order statistic)."""
    return present(R.cut_lines(tx_events(spark, sf)))


@register("per_card_stats", with_sql(O.TX, f"""
SELECT count(*) AS count, {RND('avg(n)')} AS mean, {RND('stddev_samp(n)')} AS std, {RND('min(n)')} AS min,
  {RND('quantile_cont(n, 0.25)')} AS p25, {RND('quantile_cont(n, 0.5)')} AS p50, {RND('quantile_cont(n, 0.75)')} AS p75,
  {RND('max(n)')} AS max
FROM (SELECT cc_num, count(*) AS n FROM tx GROUP BY cc_num)"""))
def q_per_card_stats(spark, sf):
    """M5."""
    return present(R.describe_counts(tx_events(spark, sf)))


def _hist_sql(src: str, value: str, bins: int, by: str | None, density: bool) -> str:
    g = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON true"
    dens = f", {RND('CASE WHEN (hi - lo) > 0 THEN n / (cnt * ((hi - lo) / ' + str(bins) + '.0)) END')} AS density" if density else ""
    return f"""
SELECT {g}CAST(bin AS BIGINT) AS bin, {RND(f'lo + bin * ((hi - lo) / {bins}.0)')} AS "left",
       {RND(f'lo + (bin + 1) * ((hi - lo) / {bins}.0)')} AS "right", n{dens}
FROM (
  SELECT {g}lo, hi, cnt, bin, count(*) AS n FROM (
    SELECT {('s.' + by + ', ') if by else ''}r.lo, r.hi, r.cnt,
           least(CASE WHEN r.hi > r.lo THEN floor((s.v - r.lo) * {bins} / (r.hi - r.lo)) ELSE 0 END, {bins - 1}) AS bin
    FROM {src} s JOIN (SELECT {g}min(v) AS lo, max(v) AS hi, count(v) AS cnt FROM {src} GROUP BY ALL) r {on}
    WHERE s.v IS NOT NULL)
  GROUP BY ALL)"""


@register("histogram_card_tx", with_sql(O.TX + """,
hv AS (SELECT CAST(count(*) AS DOUBLE) AS v FROM tx GROUP BY cc_num)""", _hist_sql("hv", "v", HIST_CARD_BINS, None, False)))
def q_histogram_card_tx(spark, sf):
    """M6: transactions per card, 40 equal-width bins."""
    per = R.per_card_counts(tx_events(spark, sf)).select(F.col("n").cast("double").alias("v"))
    return present(R.histogram(per, "v", HIST_CARD_BINS))


@register("histogram_amount", with_sql(O.TX + """,
hv AS (SELECT CAST(is_fraud AS BIGINT) AS is_fraud, ln(1 + amt) AS v FROM tx)""", _hist_sql("hv", "v", HIST_AMT_BINS, "is_fraud", True)))
def q_histogram_amount(spark, sf):
    """M6: log1p(amount) per class, 60 bins over each class's own range, with density."""
    tx = tx_events(spark, sf).select(F.col("is_fraud").cast("bigint").alias("is_fraud"), F.log(1.0 + F.col("amt")).alias("v"))
    return present(R.histogram(tx, "v", HIST_AMT_BINS, by="is_fraud", density=True))


@register("amount_by_class", with_sql(O.TX, f"""
SELECT CAST(is_fraud AS BIGINT) AS is_fraud, {RND('median(amt)')} AS median_amt FROM tx GROUP BY is_fraud"""))
def q_amount_by_class(spark, sf):
    """M7: exact median per class (class groups can be huge: no group is collected)."""
    tx = tx_events(spark, sf).withColumn("is_fraud", F.col("is_fraud").cast("bigint"))
    return present(R.median_by_class(tx))


@register("boxplot", with_sql(O.TX + f""",
bq AS (SELECT CAST(is_fraud AS BIGINT) AS is_fraud, quantile_cont(amt, 0.25) AS q1, quantile_cont(amt, 0.5) AS med,
              quantile_cont(amt, 0.75) AS q3 FROM tx GROUP BY 1)""", f"""
SELECT b.is_fraud, {RND('q1')} AS q1, {RND('med')} AS median, {RND('q3')} AS q3,
  {RND('min(CASE WHEN amt >= q1 - 1.5 * (q3 - q1) THEN amt END)')} AS whisker_lo,
  {RND('max(CASE WHEN amt <= q3 + 1.5 * (q3 - q1) THEN amt END)')} AS whisker_hi,
  CAST(sum(CASE WHEN amt < q1 - 1.5 * (q3 - q1) OR amt > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS outliers,
  {RND('q3 - q1')} AS iqr
FROM tx JOIN bq b ON CAST(tx.is_fraud AS BIGINT) = b.is_fraud GROUP BY b.is_fraud, q1, med, q3"""))
def q_boxplot(spark, sf):
    """M8."""
    tx = tx_events(spark, sf).withColumn("is_fraud", F.col("is_fraud").cast("bigint"))
    return present(R.boxplot(tx))


@register("rate_by_hour", with_sql(O.FEAT, f"""
SELECT CAST("hour" AS BIGINT) AS hour, count(*) AS n, {RND('avg(CAST(is_fraud AS DOUBLE))')} AS fraud_rate FROM feat GROUP BY 1"""))
def q_rate_by_hour(spark, sf):
    """M9 by UTC hour."""
    return present(R.rate_by(processed(spark, sf).features, F.col("hour").cast("bigint"), "hour"))


@register("rate_by_dow", with_sql(O.FEAT, f"""
SELECT CAST(dow AS BIGINT) AS dow, count(*) AS n, {RND('avg(CAST(is_fraud AS DOUBLE))')} AS fraud_rate FROM feat GROUP BY 1"""))
def q_rate_by_dow(spark, sf):
    """M9 by weekday (Monday = 0)."""
    return present(R.rate_by(processed(spark, sf).features, F.col("dow").cast("bigint"), "dow"))


@register("rate_by_category", with_sql(O.TX, f"""
SELECT category, count(*) AS n, {RND('avg(CAST(is_fraud AS DOUBLE))')} AS fraud_rate FROM tx GROUP BY 1 ORDER BY fraud_rate DESC"""))
def q_rate_by_category(spark, sf):
    """Fraud rate and size per category, highest rate first."""
    return present(R.rate_by(tx_events(spark, sf), "category", "category").orderBy(F.col("fraud_rate").desc()))


CORR_COLS = O.NUMERIC + ["is_fraud"]


@register("corr_matrix", with_sql(O.FEAT, "\nUNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, {RND(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))')} AS r FROM feat"
    for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i:])))
def q_corr_matrix(spark, sf):
    """Pearson correlation of the numeric features and the label."""
    return present(R.corr_matrix(processed(spark, sf).features, CORR_COLS))


def _auc_sql() -> str:
    parts = "\n  UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, CAST(is_fraud AS BIGINT) AS y FROM sp WHERE split = 0"
                                 for c in O.NUMERIC)
    return with_sql(O.SPLIT + f""",
lv AS (
  {parts}),
vc AS (SELECT feature, value, sum(y) AS pos, sum(1 - y) AS neg FROM lv WHERE value IS NOT NULL GROUP BY feature, value),
cu AS (SELECT *, sum(neg) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) - neg AS below,
              sum(pos) OVER (PARTITION BY feature) AS P, sum(neg) OVER (PARTITION BY feature) AS N FROM vc),
fa AS (SELECT feature, CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (below + neg / 2.0::DOUBLE)) / (max(P) * max(N)) END AS a
       FROM cu GROUP BY feature)""", "SELECT feature, " + RND("greatest(a, 1 - a)") + " AS auc FROM fa")


@register("feature_auc", _auc_sql())
def q_feature_auc(spark, sf):
    """Single-feature ROC-AUC on TRAIN, max(a, 1 - a)."""
    f = processed(spark, sf).features.where("split = 0")
    return present(R.feature_auc(f, O.NUMERIC))


@register("leak_alarm", _auc_sql().replace("SELECT feature, " + RND("greatest(a, 1 - a)") + " AS auc FROM fa",
                                           f"SELECT {RND('max(greatest(a, 1 - a))')} AS max_auc, max(greatest(a, 1 - a)) > 0.95 AS alarm FROM fa"))
def q_leak_alarm(spark, sf):
    """Alarm when any single feature separates the classes too well (AUC > 0.95)."""
    f = processed(spark, sf).features.where("split = 0")
    return present(R.leak_alarm(R.feature_auc(f, O.NUMERIC)))
