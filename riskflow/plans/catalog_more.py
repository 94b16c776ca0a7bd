"""Registered queries on branches the first groups do not reach: damaged alerts, decision tiers, validated lookups,
request windows, the feed sink, latency figures, plain losses, joined codes and a firing alarm."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups as J
from ..operators import metrics as M
from ..operators import triage as K
from ..operators.encode import apply_categories_join
from ..operators.features import causal_features, with_user
from ..functions.keys import card_key
from ..schema import RAW_TX, SEQ_LEN, FeatureSpec
from ..session import scratch_path
from ..sources.adapters import tx_events
from ..sources.io import read_transactions
from ..sources.tables import read_table
from ..streaming.jobs import run_alarm, run_alerts
from ..streaming.rate import ALARM_LIMIT, alarm, alert_rate
from . import oracle_sql as O
from .build import features_table
from .catalog import ORACLE, processed, register, scored, with_sql
from .catalog_report import PROFILE, top_as_text
from .catalog_serving import ALERTS_SQL, THR, TUNED, fallback_sql, flagged, parsed_alerts, tuned_threshold
from .catalog_stream import _run
from .present import present
from .serving import history_requests, request_windows, scored_feed, write_feed

RND = O.RND

# ---------------------------------------------------------------- alerts and decisions
# K1 with damaged payloads: by the alert's number, its JSON is cut short, or loses a field, or has a wrong probability
BROKEN_SQL = ALERTS_SQL + """,
broken AS (SELECT alert_id, CASE alert_id % 8 WHEN 1 THEN 'unparseable alert' WHEN 2 THEN 'missing tx' WHEN 3 THEN 'missing amt'
  WHEN 4 THEN 'missing category' WHEN 5 THEN 'prob outside [0, 1]' END AS error FROM alerts WHERE error IS NULL)"""


def broken_payload(spark, sf):
    """Alert payloads of which five in eight are damaged, each in its own way (input of the quarantine queries)."""
    f = flagged(spark, sf).where("flag").withColumn("amt", F.col("amt_raw"))
    value, kind = F.col("value"), F.pmod(F.col("alert_id"), F.lit(8))
    damaged = (F.when(kind == 1, F.lit("{ no json")).when(kind == 2, F.regexp_replace(value, '"tx":', '"other":'))
               .when(kind == 3, F.regexp_replace(value, '"amt":[^,]*,', "")).when(kind == 4, F.regexp_replace(value, '"category":[^,]*,', ""))
               .when(kind == 5, F.regexp_replace(value, '"prob":[^}]*', '"prob":1.5')).otherwise(value))
    return K.alert_payload(f).withColumn("value", damaged)


@register("alert_quarantine", with_sql(BROKEN_SQL, "SELECT alert_id, error IS NULL AS valid, error FROM broken"))
def q_alert_quarantine(spark, sf):
    """K1 on payloads of which some are damaged: every row is kept, with its error."""
    return K.parse_alerts(broken_payload(spark, sf)).select("alert_id", "valid", "error")


@register("stream_quarantine", with_sql(BROKEN_SQL, "SELECT alert_id, error FROM broken WHERE error IS NOT NULL"))
def q_stream_quarantine(spark, sf):
    """K1 + L7: a stream of alert payloads, some damaged; the invalid ones end in the quarantine sink with their error."""
    src = scratch_path(spark, "payloads")
    broken_payload(spark, sf).write.parquet(src)
    return spark.read.parquet(run_alerts(spark, src).quarantine).select("alert_id", "error")


@register("stream_enriched", ORACLE["alert_enrich"])
def q_stream_enriched(spark, sf):
    """L7 + K2: the streamed alerts, each micro-batch enriched with profile, last 5 transactions and segment rate."""
    return present(top_as_text(spark.read.parquet(_run(spark, sf).alerts)).select("alert_id", "card_id", *K.ENRICHED))


@register("stream_metrics", ORACLE["alert_rate"])
def q_stream_metrics(spark, sf):
    """The alert-rate windows of the metric sink, the last one included; equal to the batch form."""
    return present(spark.read.parquet(_run(spark, sf).metrics).select("window_start", "total", "alerts", "rate"))


@register("triage_tiers", with_sql(ALERTS_SQL, f"""
SELECT alert_id,
  CASE alert_id % 5 WHEN 0 THEN 'allow' WHEN 1 THEN 'review' WHEN 2 THEN 'block' ELSE {fallback_sql('score')} END AS action,
  CASE alert_id % 5 WHEN 0 THEN 'seen before' WHEN 1 THEN 'from text' WHEN 2 THEN 'from text' ELSE 'fallback' END AS rationale,
  CASE alert_id % 5 WHEN 0 THEN 0.75 WHEN 1 THEN NULL WHEN 2 THEN 0.5 ELSE {RND('score')} END AS confidence,
  CASE alert_id % 5 WHEN 0 THEN 'structured' WHEN 1 THEN 'extracted' WHEN 2 THEN 'extracted' ELSE 'fallback' END AS decision_source
FROM alerts WHERE error IS NULL"""))
def q_triage_tiers(spark, sf):
    """K4: decision tables made from the alerts' numbers reach all tiers: structured (with an invalid duplicate), an
    invalid structured decision replaced by the extracted one, extracted alone, and the fallback."""
    a = parsed_alerts(spark, sf).where("valid")
    kind = F.pmod(F.col("alert_id"), F.lit(5))

    def table(*rows):
        parts = [a.where(kind == k).select("alert_id", F.lit(action).alias("action"), F.lit(why).alias("rationale"), F.lit(conf).cast("double").alias("confidence"))
                 for k, action, why, conf in rows]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    structured = table((0, "allow", "seen before", 0.75), (0, "destroy", "unknown action", 0.9), (1, "block", "no such confidence", 1.5))
    extracted = table((1, "review", "from text", None), (2, "block", "from text", 0.5), (0, "block", "outvoted", 0.9))
    r = K.resolve(a, structured=structured, extracted=extracted)
    return present(r.select("alert_id", "decision.action", "decision.rationale", "decision.confidence", "decision_source"))


# ---------------------------------------------------------------- files
_CSV_FEATS = ", ".join(RND(f'"{c}"', 4) + f' AS "{c}"' for c in O.NUMERIC)


@register("csv_roundtrip", with_sql(O.FEAT, f'SELECT "user", unix_time, {_CSV_FEATS} FROM feat'))
def q_csv_roundtrip(spark, sf):
    """A1/A2: transactions written as two CSV files in time order and read back by the multi-file reader, whose ties
    must be distinct; the causal features of what was read."""
    base = scratch_path(spark, "csv")
    tx = tx_events(spark, sf)
    cols = [f.name for f in RAW_TX.fields if f.name in tx.columns and f.name != "tie"]
    (tx.repartitionByRange(2, "unix_time", "tie").sortWithinPartitions("unix_time", "tie").select(cols)
       .write.option("header", True).csv(base))
    found = sorted(r[0] for r in spark.read.text(base).select("_metadata.file_path").distinct().collect())     # two files
    back = read_transactions(spark, found)
    facts = back.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("tie").alias("ties")).first()
    if facts["rows"] != facts["ties"]:
        raise RuntimeError("rows of the CSV files share a tie")
    return present(causal_features(with_user(back)).select("user", "unix_time", *O.NUMERIC), {c: 4 for c in O.NUMERIC})


@register("csv_folder", with_sql(O.FEAT, f"""
SELECT "user", CAST(row_number() OVER (ORDER BY unix_time, tie) - 1 AS BIGINT) AS tie, unix_time, {_CSV_FEATS} FROM feat"""))
def q_csv_folder(spark, sf):
    """A1/A2: transactions written as a folder of five CSV files in time order and read back by the folder's name, every file
    cut into several blocks; ties are the rows' numbers in time order, the causal features are those of the source."""
    base = scratch_path(spark, "csv-folder")
    tx = tx_events(spark, sf)
    cols = [f.name for f in RAW_TX.fields if f.name in tx.columns and f.name != "tie"]
    (tx.repartitionByRange(5, "unix_time", "tie").sortWithinPartitions("unix_time", "tie").select(cols)
       .write.option("header", True).csv(base))
    size = spark.read.format("binaryFile").load(base).agg(F.max("length")).first()[0]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(1, size // 7)))
    try:
        back = read_transactions(spark, [base])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return present(causal_features(with_user(back)).select("user", "tie", "unix_time", *O.NUMERIC), {c: 4 for c in O.NUMERIC})


# ---------------------------------------------------------------- lookups and serving
LOOKUP_REQ = """
req AS (SELECT CASE WHEN c.c_custkey % 11 = 0 THEN ' ' ELSE CAST(c.c_custkey AS VARCHAR) END AS card_id, CAST(c.c_nationkey AS BIGINT) AS k,
  CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE coalesce(x.category, 'none') END AS category, CASE WHEN c.c_custkey % 17 = 0 THEN '' ELSE n.n_name END AS state, c.c_custkey AS request_id
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN (SELECT cc_num, max(category) AS category FROM tx GROUP BY cc_num) x ON x.cc_num = CAST(c.c_custkey AS VARCHAR)),
chk AS (SELECT *, CASE WHEN trim(coalesce(card_id, '')) = '' THEN 'card_id must be a non-empty string.'
  WHEN k IS NULL OR k <= 0 THEN 'k must be a positive integer.' WHEN trim(coalesce(category, '')) = '' THEN 'category must be a non-empty string.'
  WHEN trim(coalesce(state, '')) = '' THEN 'state must be a non-empty string.' END AS error FROM req)"""


@register("lookup_requests", with_sql(PROFILE + "," + LOOKUP_REQ + f""",
segs AS (SELECT category, state, {RND('avg(CAST(is_fraud AS DOUBLE))', 4)} AS fraud_rate FROM tx WHERE category IS NOT NULL AND state IS NOT NULL GROUP BY 1, 2),
last AS (SELECT cc_num, unix_time, tie, amt, category, state, row_number() OVER (PARTITION BY cc_num ORDER BY unix_time DESC, tie DESC) AS r FROM tx),
rows_of AS (SELECT q.request_id, string_agg(CAST(l.unix_time AS VARCHAR) || '@' || CAST(CAST(round({RND('amt', 2)} * 100) AS BIGINT) AS VARCHAR) || '@' || l.category || '@' || l.state, ';'
              ORDER BY l.unix_time, l.tie) AS recent FROM chk q JOIN last l ON l.cc_num = q.card_id AND l.r <= q.k WHERE q.error IS NULL GROUP BY q.request_id)""", """
SELECT q.request_id, q.error, CASE WHEN q.error IS NULL THEN coalesce(p.tx_count, 0) END AS tx_count,
  CASE WHEN q.error IS NULL THEN coalesce(p.median_amt, 0.0) END AS median_amt,
  CASE WHEN q.error IS NULL THEN coalesce(c.recent, '') END AS recent, CASE WHEN q.error IS NULL THEN coalesce(s.fraud_rate, 0.0) END AS fraud_rate
FROM chk q LEFT JOIN profile p ON p.card_id = q.card_id LEFT JOIN rows_of c ON c.request_id = q.request_id LEFT JOIN segs s ON s.category = q.category AND s.state = q.state"""))
def q_lookup_requests(spark, sf):
    """J8 end to end: requests of every customer, good ones answered by the three lookups, bad ones with their error."""
    c = read_table(spark, sf, "customer", ["c_custkey", "c_nationkey"])
    n = read_table(spark, sf, "nation", ["n_nationkey", "n_name"])
    tx = tx_events(spark, sf)
    liked = tx.groupBy(F.col("cc_num").alias("_card")).agg(F.max("category").alias("_category"))
    key = F.col("c_custkey")
    req = (c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(liked, key.cast("string") == F.col("_card"), "left")
           .select(key.alias("request_id"), F.when(key % 11 == 0, " ").otherwise(key.cast("string")).alias("card_id"), F.col("c_nationkey").cast("long").alias("k"),
                   F.when(key % 13 != 0, F.coalesce("_category", F.lit("none"))).alias("category"), F.when(key % 17 == 0, "").otherwise(F.col("n_name")).alias("state")))
    out = J.answer_requests(req, tx)
    cents = lambda v: F.round(v["amt"] * 100).cast("long").cast("string")
    rows = F.when(F.col("recent").isNotNull(), F.concat_ws(";", F.transform(
        "recent", lambda v: F.concat_ws("@", v["unix_time"].cast("string"), cents(v), v["category"], v["state"]))))
    return present(out.select("request_id", "error", "tx_count", "median_amt", rows.alias("recent"), "fraud_rate"))


@register("feed_sink", with_sql(TUNED, f"""
SELECT cc_num AS card_id, unix_time, amt_raw AS amt, category, state, {RND('prob', 4)} AS fraud_probability,
       prob >= {THR} AS is_fraud, tie FROM scored"""))
def q_feed_sink(spark, sf):
    """A10: the scored feed written as JSON lines and read back."""
    path = scratch_path(spark, "feed")
    write_feed(scored_feed(scored(spark, sf), tuned_threshold(spark, sf)), path)
    schema = "card_id string, unix_time long, amt double, category string, state string, fraud_probability double, is_fraud boolean, tie long"
    return present(spark.read.schema(schema).json(path))


def _request_windows_sql() -> str:
    nums = ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in ("lat", "long", "merch_lat", "merch_long"))
    texts = ", ".join(f"coalesce({c}, '') AS {c}" for c in ("category", "gender", "state"))
    cols = O.NUMERIC + O.CODES
    pack = ", ".join(f'"{c}" := CAST("{c}" AS DOUBLE)' for c in cols)
    step = f"CASE WHEN s.step >= {SEQ_LEN} - coalesce(len(l), 0) THEN l[s.step - {SEQ_LEN} + len(l) + 1]"
    pick = ", ".join(RND(f'{step}."{c}" ELSE 0.0 END', 4) + f' AS "{c}"' for c in cols)
    body = TUNED + f""",
rq0 AS (SELECT *, row_number() OVER (PARTITION BY cc_num ORDER BY unix_time DESC, tie DESC) AS rd FROM tx),
rq AS (SELECT cc_num AS request_id, unix_time, tie, CAST(coalesce(amt, 0.0) AS REAL) AS amt, {nums}, {texts}
       FROM rq0 WHERE rd <= {SEQ_LEN})""" + O.feat_cte("rqf", "rq", "request_id") + O.coded_scored_cte("rqs", "rqf") + f""",
rql AS (SELECT request_id, list(struct_pack({pack}) ORDER BY unix_time, tie) AS l FROM rqs GROUP BY request_id)"""
    return with_sql(body, f"""
SELECT r.request_id, CAST(s.step AS BIGINT) AS step, {pick}
FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS request_id FROM customer) r LEFT JOIN rql ON rql.request_id = r.request_id CROSS JOIN range(0, {SEQ_LEN}) s(step)""")


@register("request_windows", _request_windows_sql())
def q_request_windows(spark, sf):
    """The (steps x features) window of every request's raw history, zeros in front and where the history is empty."""
    p = processed(spark, sf)
    keys = read_table(spark, sf, "customer", ["c_custkey"]).select(F.col("c_custkey").cast("string").alias("request_id"))
    w = request_windows(history_requests(tx_events(spark, sf), keys, SEQ_LEN), p, SEQ_LEN)
    cols = O.NUMERIC + O.CODES
    x = w.select("request_id", F.posexplode("window").alias("step", "v"))
    return present(x.select("request_id", F.col("step").cast("long").alias("step"),
                            *[F.col("v")[i].cast("double").alias(c) for i, c in enumerate(cols)]), {c: 4 for c in cols})


# ---------------------------------------------------------------- keys and toggles
@register("card_key_fallback", with_sql(O.TX, """
SELECT tie, CASE WHEN tie % 3 <> 0 THEN cc_num WHEN tie % 2 = 0 THEN 'u' || cc_num ELSE 'unknown' END AS card FROM tx"""))
def q_card_key_fallback(spark, sf):
    """B5 on records of which a third have no card number, and half of those no user either."""
    tx = tx_events(spark, sf).withColumn("user_id", F.when(F.col("tie") % 2 == 0, F.concat(F.lit("u"), "cc_num")))
    tx = tx.withColumn("cc_num", F.when(F.col("tie") % 3 != 0, F.col("cc_num")))
    return tx.select("tie", card_key(tx).alias("card"))


#: Two settings of the toggles and the columns that they leave, in the fixed order
TOGGLED = {
    "few": (FeatureSpec(amount_log=False, rolling_aggs=False, time_features=False), ["amt", "dt", "geo_dist"]),
    "stateless": (FeatureSpec(time_deltas=False, rolling_aggs=False), ["amt", "amt_log", "geo_dist", "hour", "dow"]),
}


def _toggled_sql() -> str:
    parts = [f"SELECT '{name}' AS spec, tie, {i} AS place, '{c}' AS feature, {RND(f'CAST(\"{c}\" AS DOUBLE)', 4)} AS value FROM feat"
             for name, (_, cols) in TOGGLED.items() for i, c in enumerate(cols)]
    return with_sql(O.FEAT, "\nUNION ALL ".join(parts))


@register("features_toggled", _toggled_sql())
def q_features_toggled(spark, sf):
    """Features with groups off, in long form with the place of each column in the emitted order."""
    tx, parts = tx_events(spark, sf), []
    for name, (spec, _) in TOGGLED.items():
        f = features_table(tx, spec)
        emitted = [c for c in f.columns if c in O.NUMERIC]
        emitted.sort(key=spec.numeric().index)
        items = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for i, c in enumerate(emitted)])
        parts.append(f.select(F.lit(name).alias("spec"), "tie", F.inline(items)))
    return present(parts[0].unionByName(parts[1]), {"value": 4})


# ---------------------------------------------------------------- metrics and codes
@register("latency_summary", f"""
SELECT {RND('quantile_cont(l_extendedprice, 0.5)')} AS p50, {RND('quantile_cont(l_extendedprice, 0.99)')} AS p99, count(l_extendedprice) AS n FROM lineitem""")
def q_latency_summary(spark, sf):
    """I9 over a numeric measure of the given tables taken as the latency log."""
    log = read_table(spark, sf, "lineitem", ["l_extendedprice"]).select(F.col("l_extendedprice").cast("double").alias("latency_ms"))
    return present(M.latency_summary(log))


@register("focal_loss_plain", with_sql(O.SCORED, f"""
SELECT {RND('avg(greatest(logit, 0.0) - logit * CAST(y AS DOUBLE) + ln(1 + exp(-abs(logit))))')} AS focal_loss FROM scored"""))
def q_focal_loss_plain(spark, sf):
    """I7 without class weights (alpha < 0) and with gamma 0: plain cross entropy."""
    return present(M.mean_loss(scored(spark, sf), "focal", alpha=-1.0, gamma=0.0))


@register("category_codes_join", ORACLE["category_codes"])
def q_category_codes_join(spark, sf):
    """E2 by joins with the fitted table, the way of columns with many codes."""
    p = processed(spark, sf)
    f = apply_categories_join(p.features, p.category_map, list(p.spec.categorical))
    return present(f.select("tie", "split", *O.CODES))


@register("alarm_days", with_sql(TUNED + f""",
pts AS (SELECT unix_time - (unix_time % 3600) AS window_start,
               sum(CASE WHEN prob >= {THR} THEN 1 ELSE 0 END) / count(*) AS rate FROM scored GROUP BY 1),
per AS (SELECT window_start - (window_start % 86400) AS period, avg(rate) AS avg_rate FROM pts GROUP BY 1),
br AS (SELECT * FROM per WHERE avg_rate > {ALARM_LIMIT})""", f"""
SELECT period, {RND('avg_rate')} AS avg_rate FROM br b WHERE EXISTS (SELECT 1 FROM br p WHERE p.period = b.period - 86400)"""))
def q_alarm_days(spark, sf):
    """L6 (batch form) on hourly points: days whose mean alert rate exceeded the limit two days running."""
    return present(alarm(alert_rate(flagged(spark, sf), seconds=3600), period=86400, periods=2))


@register("stream_alarm", ORACLE["alarm_days"])
def q_stream_alarm(spark, sf):
    """L6 on the feature stream's sink: hourly metric windows, chained into days, and a detector of two days in a row."""
    run = _run(spark, sf)
    days = run_alarm(spark, run.features, processed(spark, sf), tuned_threshold(spark, sf), delay_seconds=run.span + 1, seconds=3600, period=86400, periods=2)
    return present(days)
