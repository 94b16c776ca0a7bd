"""Registered serving (H3, H4, A10), alert / triage (K1-K6), sampling (J7, J8) and metric-stream
batch-form (L5, L6) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups as J
from ..operators import metrics as M
from ..operators import triage as K
from ..operators.scoring import LINEAR_BIAS, latest_per_card
from ..schema import BLOCK_THRESHOLD, REVIEW_THRESHOLD, SEQ_LEN
from ..sources.adapters import tx_events
from ..sources.tables import read_table
from ..streaming.rate import ALARM_LIMIT, ALARM_SECONDS, METRIC_SECONDS, alarm, alert_rate
from . import oracle_sql as O
from .catalog import _memo, processed, register, scored, with_sql
from .catalog_report import PROFILE, top_as_text
from .present import present
from .serving import history_requests, score_requests, scored_feed

RND = O.RND
# scored rows plus the threshold tuned on VAL (the F1-optimal operating point)
TUNED = O.SCORED + O.curve_ctes("scored", "split = 1", "vcur")
THR = O.best_thr_sql("vcur")


def tuned_threshold(spark, sf) -> float:
    return _memo(spark, sf, "threshold", lambda: M.best_threshold(scored(spark, sf).where("split = 1")))


def flagged(spark, sf):
    thr = tuned_threshold(spark, sf)
    return scored(spark, sf).withColumn("flag", F.col("prob") >= F.lit(thr))


def fallback_sql(p: str) -> str:
    return (f"CASE WHEN {p} >= {BLOCK_THRESHOLD} THEN 'block' WHEN {p} >= {REVIEW_THRESHOLD} THEN 'review' "
            f"ELSE 'allow' END")


@register("score_latest", with_sql(TUNED, f"""
SELECT "user" AS card_id, unix_time, rows_considered, {RND('prob')} AS prob, prob >= {THR} AS flag FROM (
  SELECT "user", unix_time, prob, count(*) OVER (PARTITION BY "user") AS rows_considered,
         row_number() OVER (PARTITION BY "user" ORDER BY unix_time DESC, tie DESC) AS r FROM scored)
WHERE r = 1"""))
def q_score_latest(spark, sf):
    """H3: every card scored by its newest transaction, with rows considered."""
    s = flagged(spark, sf).select("user", "unix_time", "tie", "prob", "flag")
    out = latest_per_card(s, "user")
    return present(out.select(F.col("user").alias("card_id"), "unix_time", "rows_considered", "prob", "flag"))


def _requests_sql() -> str:
    nums = ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in ("lat", "long", "merch_lat", "merch_long"))
    texts = ", ".join(f"coalesce({c}, '') AS {c}" for c in ("category", "gender", "state"))
    body = TUNED + f""",
rq0 AS (SELECT *, row_number() OVER (PARTITION BY cc_num ORDER BY unix_time DESC, tie DESC) AS rd FROM tx),
rq AS (SELECT cc_num AS request_id, unix_time, tie, CAST(coalesce(amt, 0.0) AS REAL) AS amt, {nums}, {texts}
       FROM rq0 WHERE rd <= {SEQ_LEN})""" + O.feat_cte("rqf", "rq", "request_id") + """,
rql AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY request_id) AS n_rows,
          row_number() OVER (PARTITION BY request_id ORDER BY unix_time DESC, tie DESC) AS lr FROM rqf) WHERE lr = 1)""" \
        + O.coded_scored_cte("rqs", "rql")
    empty_p = O.sigmoid_sql(f"({LINEAR_BIAS})")
    return with_sql(body, f"""
SELECT r.request_id, CAST(coalesce(s.n_rows, 0) AS BIGINT) AS n_rows, {RND(f'coalesce(s.logit, {LINEAR_BIAS})')} AS logit,
       {RND(f'coalesce(s.prob, {empty_p})')} AS prob, coalesce(s.prob, {empty_p}) >= {THR} AS flag
FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS request_id FROM customer) r LEFT JOIN rqs s ON s.request_id = r.request_id""")


@register("score_requests", _requests_sql())
def q_score_requests(spark, sf):
    """H4: stateless scoring of inline histories, one request per customer (its card's last 32
    transactions; customers without transactions send an empty history)."""
    p = processed(spark, sf)
    keys = read_table(spark, sf, "customer", ["c_custkey"]).select(F.col("c_custkey").cast("string").alias("request_id"))
    req = history_requests(tx_events(spark, sf), keys, SEQ_LEN)
    return present(score_requests(req, p, tuned_threshold(spark, sf)))


@register("score_feed", with_sql(TUNED, f"""
SELECT cc_num AS card_id, unix_time, amt_raw AS amt, category, state, {RND('prob', 4)} AS fraud_probability,
       prob >= {THR} AS is_fraud, tie FROM scored ORDER BY unix_time, tie"""))
def q_score_feed(spark, sf):
    """A10 / H2: the scored feed of every transaction in global time order."""
    return present(scored_feed(scored(spark, sf), tuned_threshold(spark, sf)))


ALERTS_SQL = TUNED + """,
alerts AS (SELECT tie AS alert_id, cc_num AS card_id, amt_raw AS amt, category, state, unix_time, prob AS score,
                  CASE WHEN amt_raw IS NULL THEN 'missing amt' WHEN category IS NULL THEN 'missing category'
                       WHEN state IS NULL THEN 'missing state' WHEN unix_time IS NULL THEN 'missing unix_time'
                       WHEN prob IS NULL OR prob < 0 OR prob > 1 THEN 'prob outside [0, 1]' END AS error
           FROM scored WHERE prob >= """ + THR + ")"


def parsed_alerts(spark, sf):
    def make():
        f = flagged(spark, sf).where("flag").withColumn("amt", F.col("amt_raw"))
        return K.parse_alerts(K.alert_payload(f))
    return _memo(spark, sf, "alerts", make)


@register("alert_validate", with_sql(ALERTS_SQL, f"""
SELECT alert_id, card_id, amt, category, state, unix_time, {RND('score')} AS score, error IS NULL AS valid, error FROM alerts"""))
def q_alert_validate(spark, sf):
    """K1 (+ A8 payload): alerts at the tuned threshold encoded as JSON, decoded and validated."""
    a = parsed_alerts(spark, sf)
    return present(a.select("alert_id", "card_id", "amt", "category", "state", "unix_time", "score", "valid", "error"))


@register("triage_fallback", with_sql(ALERTS_SQL, f"""
SELECT alert_id, {fallback_sql('score')} AS action, 'fallback' AS rationale, {RND('score')} AS confidence,
       'fallback' AS decision_source FROM alerts WHERE error IS NULL"""))
def q_triage_fallback(spark, sf):
    """K3/K4: one decision per valid alert; without decision tables every alert takes the fallback."""
    a = K.resolve(parsed_alerts(spark, sf).where("valid"))
    return present(a.select("alert_id", "decision.action", "decision.rationale", "decision.confidence", "decision_source"))


PROFILE_TAIL = PROFILE[len(O.TX):]


@register("alert_enrich", with_sql(ALERTS_SQL + PROFILE_TAIL + f""",
rec AS (
  SELECT card_id, string_agg(CAST(unix_time AS VARCHAR) || '@' || CAST(CAST(round({RND('amt', 2)} * 100) AS BIGINT) AS VARCHAR), ';'
                             ORDER BY unix_time, tie) AS recent
  FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY unix_time DESC, tie DESC) AS r FROM t) WHERE r <= 5
  GROUP BY card_id),
seg AS (SELECT category, state, {RND('avg(CAST(is_fraud AS DOUBLE))', 4)} AS segment_rate FROM tx
        WHERE category IS NOT NULL AND state IS NOT NULL GROUP BY category, state)""", """
SELECT a.alert_id, a.card_id, p.tx_count, p.median_amt, p.avg_amt, p.top_categories, p.home_state, r.recent,
       coalesce(s.segment_rate, 0.0) AS segment_rate
FROM alerts a LEFT JOIN profile p ON p.card_id = a.card_id LEFT JOIN rec r ON r.card_id = a.card_id
LEFT JOIN seg s ON s.category = a.category AND s.state = a.state WHERE a.error IS NULL"""))
def q_alert_enrich(spark, sf):
    """K2: each valid alert with card profile, last 5 transactions and segment fraud rate."""
    e = K.enrich(parsed_alerts(spark, sf).where("valid"), tx_events(spark, sf), 5)
    return present(top_as_text(e).select("alert_id", "card_id", "tx_count", "median_amt", "avg_amt", "top_categories",
                                         "home_state", "recent", "segment_rate"))


@register("alert_text", with_sql(ALERTS_SQL, """
SELECT alert_id, printf('Flagged transaction on card %s (model fraud score %.3f).', card_id, score) || chr(10) ||
       printf('Amount: %s, category: %s, state: %s, unix_time: %d.', CAST(amt AS VARCHAR), category, state, unix_time) AS text
FROM alerts WHERE error IS NULL"""))
def q_alert_text(spark, sf):
    """K6."""
    a = parsed_alerts(spark, sf).where("valid")
    return a.select("alert_id", K.alert_text(a).alias("text"))


@register("assess", with_sql(TUNED, f"""
SELECT "user" AS card_id, rows_considered, {RND('prob')} AS prob, prob >= {THR} AS flag,
       {fallback_sql('prob')} AS action, 'fallback' AS rationale, {RND('prob')} AS confidence FROM (
  SELECT "user", prob, count(*) OVER (PARTITION BY "user") AS rows_considered,
         row_number() OVER (PARTITION BY "user" ORDER BY unix_time DESC, tie DESC) AS r FROM scored)
WHERE r = 1"""))
def q_assess(spark, sf):
    """K5: per card, the latest score with rows considered and its resolved decision."""
    s = flagged(spark, sf).select("user", "unix_time", "tie", "prob", "flag")
    last = latest_per_card(s, "user").withColumn("score", F.col("prob")).withColumnRenamed("user", "card_id")
    r = K.resolve(last, key="card_id")
    return present(r.select("card_id", "rows_considered", "prob", "flag", "decision.action", "decision.rationale",
                            "decision.confidence"))


POOL_COLS = ["tie", "cc_num", "unix_time", "category", "gender", "state"]


@register("sample_pool", with_sql(O.SPLIT, "SELECT " + ", ".join(POOL_COLS) + ", amt_raw AS amt FROM sp WHERE split = 2 AND is_fraud = 1"))
def q_sample_pool(spark, sf):
    """J7 pool: TEST-split fraud rows the sampler draws from."""
    pool = J.test_pool(processed(spark, sf).features, fraud_only=True)
    return present(pool.select(*POOL_COLS, F.col("amt_raw").alias("amt")))


@register("sample_test", with_sql(O.SPLIT, "SELECT " + ", ".join(POOL_COLS) + """, amt_raw AS amt FROM sp WHERE split = 2 AND is_fraud = 1
ORDER BY md5(CAST(tie AS VARCHAR) || '|0'), tie LIMIT 5"""))
def q_sample_test(spark, sf):
    """A repeatable draw of 5 TEST fraud rows (seeded hash order; the limit is the feature)."""
    s = J.sample_test(processed(spark, sf).features, n=5, seed=0, fraud_only=True)
    return present(s.select(*POOL_COLS, F.col("amt_raw").alias("amt")))


@register("arg_errors", """
SELECT CAST(c.c_custkey AS VARCHAR) AS card_id, CAST(c.c_nationkey AS BIGINT) AS k, c.c_mktsegment AS category, n.n_name AS state,
  CASE WHEN c.c_custkey IS NULL OR trim(CAST(c.c_custkey AS VARCHAR)) = '' THEN 'card_id must be a non-empty string.'
       WHEN c.c_nationkey IS NULL OR c.c_nationkey <= 0 THEN 'k must be a positive integer.'
       WHEN c.c_mktsegment IS NULL OR trim(c.c_mktsegment) = '' THEN 'category must be a non-empty string.'
       WHEN n.n_name IS NULL OR trim(n.n_name) = '' THEN 'state must be a non-empty string.' END AS error
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def q_arg_errors(spark, sf):
    """Lookup requests built from customers (id, k = nation key, segment, nation name) get an
    error value instead of failing; nation key 0 is not a positive k."""
    c = read_table(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    n = read_table(spark, sf, "nation", ["n_nationkey", "n_name"])
    req = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left").select(
        F.col("c_custkey").cast("string").alias("card_id"), F.col("c_nationkey").cast("bigint").alias("k"),
        F.col("c_mktsegment").alias("category"), F.col("n_name").alias("state"))
    return present(J.validate_requests(req))


@register("alert_rate", with_sql(TUNED, f"""
SELECT unix_time - (unix_time % {METRIC_SECONDS}) AS window_start, count(*) AS total,
       CAST(sum(CASE WHEN prob >= {THR} THEN 1 ELSE 0 END) AS BIGINT) AS alerts,
       {RND(f'sum(CASE WHEN prob >= {THR} THEN 1 ELSE 0 END) / count(*)')} AS rate
FROM scored GROUP BY 1"""))
def q_alert_rate(spark, sf):
    """L5 (batch form): alerts / total per 30-second window of event time."""
    return present(alert_rate(flagged(spark, sf)))


@register("alarm", with_sql(TUNED + f""",
pts AS (SELECT unix_time - (unix_time % {METRIC_SECONDS}) AS window_start,
               sum(CASE WHEN prob >= {THR} THEN 1 ELSE 0 END) / count(*) AS rate FROM scored GROUP BY 1),
per AS (SELECT window_start - (window_start % {ALARM_SECONDS}) AS period, avg(rate) AS avg_rate FROM pts GROUP BY 1),
br AS (SELECT * FROM per WHERE avg_rate > {ALARM_LIMIT})""", f"""
SELECT period, {RND('avg_rate')} AS avg_rate FROM br b
WHERE EXISTS (SELECT 1 FROM br p WHERE p.period = b.period - {ALARM_SECONDS})
  AND EXISTS (SELECT 1 FROM br p WHERE p.period = b.period - {2 * ALARM_SECONDS})"""))
def q_alarm(spark, sf):
    """L6 (batch form): 60-second periods whose mean alert rate exceeded 5 % three periods running."""
    return present(alarm(alert_rate(flagged(spark, sf))))
