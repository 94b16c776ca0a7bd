"""DuckDB SQL building blocks that restate each operator independently (the oracle side).

They read the driver's pre-registered views. Every double output goes through ``RND`` which
rounds via DECIMAL(38,10), the same rule the Spark side uses (``riskflow.plans.present.rnd``),
so binary noise in the last bits cannot split the two results.
"""

from __future__ import annotations


def RND(x: str, d: int = 6) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {d}) AS DOUBLE)"


# Raw transactions from the test tables (same adapter as riskflow.sources.adapters.tx_events).
TX = """
tx AS (
  SELECT CAST(e.user_id AS VARCHAR) AS cc_num,
         CAST(floor(epoch(e.ts)) AS BIGINT) AS unix_time,
         e.value AS amt,
         25.0 + ((e.user_id * 7919) % 2400) / 100.0::DOUBLE AS lat,
         -124.0 + ((e.user_id * 104729) % 5700) / 100.0::DOUBLE AS long,
         25.0 + ((e.user_id * 7919 + CAST(e.props->>'$.k' AS BIGINT) * 37) % 2400) / 100.0::DOUBLE AS merch_lat,
         -124.0 + ((e.user_id * 104729 + CAST(e.props->>'$.k' AS BIGINT) * 53) % 5700) / 100.0::DOUBLE AS merch_long,
         e.event_type AS category,
         c.c_mktsegment AS gender,
         n.n_name AS state,
         CASE WHEN e.event_type = 'error' AND CAST(e.props->>'$.k' AS BIGINT) >= 90 THEN 1 ELSE 0 END AS is_fraud,
         e.event_id AS tie
  FROM events e
  LEFT JOIN customer c ON e.user_id = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

# B1 + C1-C8
FEAT = TX + """,
base AS (
  SELECT coalesce(cc_num, 'NA') AS "user", cc_num, unix_time, tie, CAST(amt AS REAL) AS amt, amt AS amt_raw,
         lat, long, merch_lat, merch_long, category, gender, state, is_fraud
  FROM tx),
feat AS (
  SELECT *,
    CAST(ln(1.0 + greatest(CAST(amt AS DOUBLE), 0.0)) AS REAL) AS amt_log,
    CAST(coalesce(unix_time - lag(unix_time) OVER w, 0) AS REAL) AS dt,
    CAST(coalesce(avg(CAST(amt AS DOUBLE)) OVER (PARTITION BY "user" ORDER BY unix_time, tie
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS REAL) AS amt_roll_mean,
    CAST(row_number() OVER w - 1 AS REAL) AS amt_count,
    CAST(sqrt(pow(lat - merch_lat, 2) + pow(long - merch_long, 2)) AS REAL) AS geo_dist,
    CAST((unix_time % 86400) // 3600 AS REAL) AS "hour",
    CAST(((unix_time // 86400) + 3) % 7 AS REAL) AS dow
  FROM base
  WINDOW w AS (PARTITION BY "user" ORDER BY unix_time, tie))"""


def split_ctes(src: str, out: str = "sp", t: str = "unix_time", test: float = 0.2, val: float = 0.1) -> str:
    """Exact order-statistic cutoffs (n_train-th and (n_train+n_val)-th smallest time)."""
    return f""",
{out}_sz AS (
  SELECT count(*) AS n, CAST(floor(count(*) * {test}::DOUBLE) AS BIGINT) AS n_test,
         CAST(floor(count(*) * {val}::DOUBLE) AS BIGINT) AS n_val FROM {src}),
{out}_ord AS (SELECT {t} AS tt, row_number() OVER (ORDER BY {t}) AS rk FROM {src}),
{out}_cut AS (
  SELECT max(CASE WHEN rk = n - n_val - n_test THEN tt END) AS c1,
         max(CASE WHEN rk = n - n_test THEN tt END) AS c2
  FROM {out}_ord, {out}_sz),
{out} AS (
  SELECT {src}.*, CASE WHEN {t} <= c1 THEN 0 WHEN {t} <= c2 THEN 1 ELSE 2 END AS split
  FROM {src}, {out}_cut)"""


SPLIT = FEAT + split_ctes("feat", "sp")

NUMERIC = ["amt", "amt_log", "dt", "amt_roll_mean", "amt_count", "geo_dist", "hour", "dow"]
CODES = ["category_code", "gender_code", "state_code"]
CATS = ["category", "gender", "state"]


def _cmap_part(c: str) -> str:
    return (f"SELECT '{c}' AS \"column\", v AS value, CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS code "
            f"FROM (SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), 'NA') AS v FROM sp WHERE split = 0)")


# E1 / E2
CODED = SPLIT + """,
cmap AS (
  """ + "\n  UNION ALL ".join(_cmap_part(c) for c in CATS) + """),
coded AS (
  SELECT sp.*, """ + ", ".join(f"coalesce(m_{c}.code, 0) AS {c}_code" for c in CATS) + """
  FROM sp
  """ + "\n  ".join(f"LEFT JOIN cmap m_{c} ON m_{c}.\"column\" = '{c}' AND m_{c}.value = coalesce(CAST(sp.{c} AS VARCHAR), 'NA')"
                   for c in CATS) + ")"

# E3 / E4
SCALED = CODED + """,
scl AS (
  SELECT """ + ",\n         ".join(
    f"avg(CAST({c} AS DOUBLE)) AS m_{c}, CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) = 0 THEN 1.0 "
    f"ELSE stddev_pop(CAST({c} AS DOUBLE)) END AS s_{c}" for c in NUMERIC) + """
  FROM coded WHERE split = 0),
scaled AS (
  SELECT coded.* REPLACE (""" + ", ".join(
    f"CAST((CAST({c} AS DOUBLE) - m_{c}) / s_{c} AS REAL) AS {c}" for c in NUMERIC) + """)
  FROM coded, scl)"""

# fixed linear scorer: the same weights, in the same association order
from ..operators.scoring import LINEAR_BIAS as BIAS  # noqa: E402
from ..operators.scoring import LINEAR_WEIGHTS  # noqa: E402

WEIGHTS = list(LINEAR_WEIGHTS.items())


def _logit() -> str:
    z = f"{BIAS}"
    for c, w in WEIGHTS:
        z = f"({z} + {w} * CAST({c} AS DOUBLE))"
    return z


def sigmoid_sql(z: str) -> str:
    return (f"CASE WHEN {z} >= 0 THEN 1.0 / (1.0 + exp(-abs({z}))) "
            f"ELSE exp(-abs({z})) / (1.0 + exp(-abs({z}))) END")


SCORED = SCALED + f""",
scored0 AS (SELECT scaled.*, {_logit()} AS logit FROM scaled),
scored AS (SELECT scored0.*, {sigmoid_sql('logit')} AS prob, is_fraud AS y FROM scored0)"""


def curve_ctes(src: str, where: str, out: str = "cur") -> str:
    """I6 cumulative frame over distinct scores, descending."""
    return f""",
{out}_cnt AS (
  SELECT prob AS threshold, CAST(sum(y) AS BIGINT) AS pos, CAST(count(*) - sum(y) AS BIGINT) AS neg
  FROM {src} WHERE {where} GROUP BY prob),
{out}_tot AS (SELECT CAST(coalesce(sum(pos), 0) AS BIGINT) AS P, CAST(coalesce(sum(neg), 0) AS BIGINT) AS N FROM {out}_cnt),
{out}_cum AS (
  SELECT threshold, pos, neg,
         CAST(sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
         CAST(sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp
  FROM {out}_cnt),
{out} AS (
  SELECT c.*, t.P, t.N,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
         CASE WHEN t.P > 0 THEN tp / t.P ELSE 1.0 END AS recall
  FROM {out}_cum c, {out}_tot t),
{out}_f AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM {out})"""


def best_thr_sql(cur: str) -> str:
    return (f"(SELECT coalesce((SELECT threshold FROM {cur}_f ORDER BY f1 DESC, threshold ASC LIMIT 1), 0.5))")


def summary_select(cur: str, thr: str | None) -> str:
    ap = f"CASE WHEN max(P) > 0 THEN sum(pos * precision) / max(P) ELSE 0.0 END"
    auc = f"CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (N - fp + neg / 2.0::DOUBLE)) / (max(P) * max(N)) END"
    cols = [f"{RND(ap)} AS pr_auc", f"{RND(auc)} AS roc_auc"]
    if thr is not None:
        cols += [f"CAST(coalesce(sum(CASE WHEN threshold >= {thr} THEN pos END), 0) AS BIGINT) AS tp",
                 f"CAST(coalesce(sum(CASE WHEN threshold >= {thr} THEN neg END), 0) AS BIGINT) AS fp",
                 f"CAST(max(P) - coalesce(sum(CASE WHEN threshold >= {thr} THEN pos END), 0) AS BIGINT) AS fn",
                 f"CAST(max(N) - coalesce(sum(CASE WHEN threshold >= {thr} THEN neg END), 0) AS BIGINT) AS tn"]
    return "SELECT " + ", ".join(cols) + f" FROM {cur}_f"


def metrics_sql(cur: str, thr: str) -> str:
    """I4 on top of a curve named ``cur``."""
    return f"""
SELECT pr_auc, roc_auc,
  {RND("CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END")} AS precision,
  {RND("CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END")} AS recall,
  {RND("CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END")} AS f1,
  {RND(thr)} AS threshold, tp, fp, fn, tn
FROM ({summary_select(cur, thr)}) s"""


def feat_cte(name: str, src: str, key: str) -> str:
    """C1-C8 over any source with the raw columns (``amt`` REAL), keyed by ``key``."""
    return f""",
{name} AS (
  SELECT *,
    CAST(ln(1.0 + greatest(CAST(amt AS DOUBLE), 0.0)) AS REAL) AS amt_log,
    CAST(coalesce(unix_time - lag(unix_time) OVER w, 0) AS REAL) AS dt,
    CAST(coalesce(avg(CAST(amt AS DOUBLE)) OVER (PARTITION BY {key} ORDER BY unix_time, tie
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS REAL) AS amt_roll_mean,
    CAST(row_number() OVER w - 1 AS REAL) AS amt_count,
    CAST(sqrt(pow(lat - merch_lat, 2) + pow(long - merch_long, 2)) AS REAL) AS geo_dist,
    CAST((unix_time % 86400) // 3600 AS REAL) AS "hour",
    CAST(((unix_time // 86400) + 3) % 7 AS REAL) AS dow
  FROM {src}
  WINDOW w AS (PARTITION BY {key} ORDER BY unix_time, tie))"""


def coded_scored_cte(name: str, src: str) -> str:
    """E2 + E4 + linear score with the train-fit ``cmap`` / ``scl`` of the SCALED block."""
    codes = ", ".join(f"coalesce(m_{c}.code, 0) AS {c}_code" for c in CATS)
    joins = "\n  ".join(f"LEFT JOIN cmap m_{c} ON m_{c}.\"column\" = '{c}' AND m_{c}.value = coalesce(CAST(s.{c} AS VARCHAR), 'NA')"
                        for c in CATS)
    scaled = ", ".join(f"CAST((CAST({c} AS DOUBLE) - m_{c}) / s_{c} AS REAL) AS {c}" for c in NUMERIC)
    return f""",
{name}_c AS (SELECT s.*, {codes} FROM {src} s
  {joins}),
{name}_s AS (SELECT {name}_c.* REPLACE ({scaled}) FROM {name}_c, scl),
{name}_z AS (SELECT {name}_s.*, {_logit()} AS logit FROM {name}_s),
{name} AS (SELECT {name}_z.*, {sigmoid_sql('logit')} AS prob FROM {name}_z)"""
