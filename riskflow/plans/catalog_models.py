"""Registered PCA (F), table round-trip (A3-A5), model (H5-H7) and run-summary (I10, A11) queries."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.models import logreg_gradient, model_scores, sequence_scores, staged_losses, tcn_init, train_gbt, train_logreg
from ..operators.pca import eigen_check, moments_table, triple_pca
from ..operators.scoring import score
from ..operators.windows import seq_windows, split_windows
from ..schema import SEQ_LEN
from ..session import scratch_path
from ..sources.io import RUN_METRICS, load_processed, read_fitted, read_run_metrics, write_bucketed, write_fitted, write_processed
from . import oracle_sql as O
from .build import feature_columns, fit_processed
from .catalog import ORACLE, _exploded, _memo, processed, register, with_sql
from .present import present

RND = O.RND


def q(c: str) -> str:
    return f'"{c}"' if c == "hour" else c


def _pca_sql() -> str:
    cols = O.NUMERIC
    st = ", ".join(f"avg(CAST({q(c)} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({q(c)} AS DOUBLE)) + 1e-8 AS s_{c}" for c in cols)
    xs = ", ".join(f"(CAST({q(c)} AS DOUBLE) - m_{c}) / s_{c} AS x_{c}" for c in cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    final = "\nUNION ALL ".join(
        f"SELECT subset, '{a}' AS f1, '{b}' AS f2, {RND(f'covar_samp(x_{a}, x_{b})')} AS cov FROM subs GROUP BY subset"
        for a, b in pairs)
    return with_sql(O.SPLIT + f""",
pst AS (SELECT {st} FROM sp WHERE split = 0),
pxs AS (SELECT is_fraud AS y, {xs} FROM sp, pst WHERE split = 0),
subs AS (SELECT 'legit' AS subset, * FROM pxs WHERE y = 0 UNION ALL SELECT 'fraud', * FROM pxs WHERE y = 1
         UNION ALL SELECT 'all', * FROM pxs)""", final)


@register("pca_moments", _pca_sql())
def q_pca_moments(spark, sf):
    """train-standardised (std + 1e-8) covariances of legit, fraud and all train rows, from one
    grouped moments pass (the 'all' subset adds the class moments)."""
    return present(moments_table(processed(spark, sf).features, O.NUMERIC))


@register("pca_projection")
def q_pca_projection(spark, sf):
    """every row projected on the three train-fit subspaces (components explaining > 90 %)."""
    f = processed(spark, sf).features
    out, names = triple_pca(f, O.NUMERIC)
    return present(out.select("tie", "split", *names), {c: 4 for c in names})


def _eigen_sql() -> str:
    cov = ORACLE["pca_moments"].rsplit("SELECT subset, '", len(O.NUMERIC) * (len(O.NUMERIC) + 1) // 2)[0]
    sel = "\nUNION ALL ".join(f"SELECT subset, {i} AS i, {j} AS j, covar_samp(x_{a}, x_{b}) AS c FROM subs GROUP BY subset"
                              for i, a in enumerate(O.NUMERIC) for j, b in enumerate(O.NUMERIC))
    return f"""{cov.rstrip()},
m AS ({sel})
SELECT a.subset, a.p1, b.p2, c.p3, CAST(0 AS DOUBLE) AS residual, CAST(0 AS DOUBLE) AS skew, true AS enough, true AS least, true AS projected FROM
  (SELECT subset, {RND('sum(c)', 4)} AS p1 FROM m WHERE i = j GROUP BY subset) a
  JOIN (SELECT subset, {RND('sum(c * c)', 4)} AS p2 FROM m GROUP BY subset) b USING (subset)
  JOIN (SELECT x.subset, {RND('sum(x.c * y.c * z.c)', 4)} AS p3 FROM m x JOIN m y ON x.subset = y.subset AND x.j = y.i
        JOIN m z ON y.subset = z.subset AND y.j = z.i AND z.j = x.i GROUP BY x.subset) c USING (subset)"""


@register("pca_residuals", _eigen_sql())
def q_pca_residuals(spark, sf):
    """eigenvalues against the traces of the covariance's powers, and what must hold of vectors and projections."""
    found = eigen_check(processed(spark, sf).features, O.NUMERIC)
    return present(found, {c: 4 for c in ("p1", "p2", "p3")})


SCALED_COLS = ["tie", "split", *O.NUMERIC, *O.CODES]


@register("table_roundtrip", with_sql(O.SCALED, "SELECT tie, split, " + ", ".join(
    f"{RND(q(c), 4)} AS {c}" for c in O.NUMERIC) + ", " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in O.CODES)
    + " FROM scaled"))
def q_table_roundtrip(spark, sf):
    """A3-A5: processed table written clustered by card, fitted tables as JSON, both read back and
    checked; the reloaded table is returned."""
    p = processed(spark, sf)
    base = scratch_path(spark, "processed")
    write_processed(p.table, f"{base}/table")
    write_fitted({"category_map": p.category_map, "scaler": p.scaler}, f"{base}/fitted")
    fitted = read_fitted(spark, f"{base}/fitted", {"category_map": "column string, value string, code int",
                                                    "scaler": "feature string, mean double, std double"})
    if fitted["scaler"].count() != len(p.stats) or fitted["category_map"].count() != p.category_map.count():
        raise RuntimeError("fitted tables did not survive the round trip")
    t = load_processed(spark, f"{base}/table", p.table.select(*SCALED_COLS).schema)
    return present(t.select(*SCALED_COLS), {c: 4 for c in O.NUMERIC})


BUCKET_ROWS = 2_000_000     # rows of a bucket, about


def bucketed(spark, sf):
    """The processed table in buckets by card, as a table of the catalog."""
    def make():
        p = processed(spark, sf)
        name = f"processed_{uuid.uuid4().hex[:12]}"
        buckets = max(8, -(-p.table.count() // BUCKET_ROWS))
        write_bucketed(p.table.select("user", "unix_time", *SCALED_COLS), name, scratch_path(spark, "bucketed"), buckets)
        return spark.table(name)
    return _memo(spark, sf, "bucketed", make)


@register("bucketed_windows", ORACLE["seq_windows"])
def q_bucketed_windows(spark, sf):
    """A3 + G1: windows over the processed table in buckets by card; the read path has no exchange."""
    return _exploded(seq_windows(bucketed(spark, sf), feature_columns(processed(spark, sf)), SEQ_LEN))


def _logreg(spark, sf, representation: str = "raw"):
    def make():
        p = processed(spark, sf) if representation == "raw" else _pca_processed(spark, sf)
        cols = feature_columns(p)
        model = train_logreg(p.table, cols)
        return p, cols, model
    return _memo(spark, sf, f"logreg-{representation}", make)


def _pca_processed(spark, sf):
    def make():
        p = processed(spark, sf)        # the projections are of the same features and split
        return fit_processed(p.features, p.cut, p.spec, "triple_pca")
    return _memo(spark, sf, "processed-pca", make)


@register("logreg_metrics")
def q_logreg_metrics(spark, sf):
    """H6: balanced logistic regression trained on TRAIN, threshold tuned on VAL, metrics on TEST."""
    p, cols, model = _logreg(spark, sf)
    return present(M.tune_and_report(model_scores(model, p.table, cols)))


@register("gbt_metrics")
def q_gbt_metrics(spark, sf):
    """H7: boosted trees (400 x depth 6, rate 0.05, positives weighted neg/pos) on TRAIN; VAL-tuned
    threshold, metrics on TEST."""
    p, cols, model = _gbt(spark, sf)
    return present(M.tune_and_report(model_scores(model, p.table, cols)))


def _gbt(spark, sf):
    def make():
        p = processed(spark, sf)
        cols = feature_columns(p)
        return p, cols, train_gbt(p.table, cols)
    return _memo(spark, sf, "gbt", make)


def _gradient_sql() -> str:
    cols = [*((c, q(c)) for c in O.NUMERIC + O.CODES), ("(intercept)", "1.0")]
    parts = "\nUNION ALL ".join(
        f"SELECT '{name}' AS feature, {RND(f'sum(w * (0.5 - y) * CAST({x} AS DOUBLE)) / count(*)', 4)} AS at_zero, CAST(0 AS DOUBLE) AS at_fit FROM wt"
        for name, x in cols)
    return with_sql(O.SCALED + """,
wt AS (SELECT *, is_fraud AS y, CASE WHEN is_fraud = 1 THEN n / (2.0::DOUBLE * pos) ELSE n / (2.0::DOUBLE * (n - pos)) END AS w
       FROM scaled, (SELECT count(*) AS n, sum(is_fraud) AS pos FROM scaled WHERE split = 0) WHERE split = 0)""", parts)


@register("logreg_gradient", _gradient_sql())
def q_logreg_gradient(spark, sf):
    """H6: derivatives of the balanced, penalised objective on TRAIN at zero coefficients and at the fit, where they vanish."""
    p, cols, model = _logreg(spark, sf)
    g = logreg_gradient(p.table, cols, list(model.coefficients), model.intercept)
    return present(g, {"at_zero": 4, "at_fit": 3})


@register("gbt_staged_loss", "SELECT CAST(400 AS BIGINT) AS trees, CAST(0 AS BIGINT) AS rises, true AS better_than_none")
def q_gbt_staged_loss(spark, sf):
    """H7: the weighted training loss after each of the 400 trees never rises, and ends below that of no tree (2 ln 2)."""
    p, cols, model = _gbt(spark, sf)
    losses = staged_losses(model, p.table, cols)
    rises = sum(b > a + 1e-12 for a, b in zip(losses, losses[1:], strict=False))
    return spark.createDataFrame([(len(losses), rises, losses[-1] < 2 * math.log(2))], "trees long, rises long, better_than_none boolean")


@register("udf_scores")
def q_udf_scores(spark, sf):
    """H5: sequence-model forward pass (causal dilated convolutions, 64-64-64, kernel 3) over every
    TEST transaction's 32-step window, in Arrow batches via mapInPandas."""
    p = processed(spark, sf)
    cols = feature_columns(p)
    wins = split_windows(p.table, "test", cols, SEQ_LEN)
    return present(sequence_scores(wins, tcn_init(len(cols))))


CELLS = [("linear", "raw"), ("logreg", "raw"), ("logreg", "triple_pca")]


def _cell_metrics(spark, sf, model: str, features: str) -> dict:
    if model == "linear":
        p = processed(spark, sf)
        scored = score(p.table).withColumn("score", F.col("prob"))
        k = len(feature_columns(p)) + 1
    else:
        p, cols, m = _logreg(spark, sf, features)
        scored = model_scores(m, p.table, cols)
        k = len(cols) + 1
    r = M.tune_and_report(scored).first()
    return {"pr_auc": r["pr_auc"], "roc_auc": r["roc_auc"], "f1": r["f1"], "threshold": r["threshold"], "n_params": k}


@register("run_summary")
def q_run_summary(spark, sf):
    """I10 + A11: each (model, features) cell writes its metric JSON; the files are read back and left joined from the
    cell list, so a cell without metrics stays as a row that says so."""
    base = scratch_path(spark, "runs")
    for model, feats in CELLS:
        row = {"model": model, "features": feats, "error": None, **_cell_metrics(spark, sf, model, feats)}
        spark.createDataFrame([row], RUN_METRICS).coalesce(1).write.mode("overwrite").json(f"{base}/{model}-{feats}")
    got = read_run_metrics(spark, f"{base}/*")
    cells = spark.createDataFrame(CELLS, "model string, features string")
    out = cells.join(got.drop("source_file"), ["model", "features"], "left")
    return present(out.withColumn("error", F.coalesce("error", F.when(F.col("pr_auc").isNull(), F.lit("no metrics")))))
