"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest (operator 4).

Features of a URL: lengths of its parts, path depth, digit ratio, character entropy, parameter counts, separators,
and statistics of its suffix: how many URLs share the host's last label, and the smoothed share of blocked ones
among the labelled URLs of that label, and of that label with the first path segment. A labelled URL's shares leave
out the labels of its own fold (``FOLDS`` by hash of the URL), so no tree learns from a share that holds the row's own
label. Trees are Spark ML's, trained on at most ``TRAIN_ROWS`` labelled URLs taken by hash; counts and shares cover all
URLs.

Defined results: null url or no ``://``: empty host and path, features of an empty URL. Repeated rows: each row on
its own. Equally long rules that fit: the one listed first. Labels of one class only: that class; no labels: allow.
Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready

#: labelled URLs the trees are trained on, at most
TRAIN_ROWS = 20_000
TREES, DEPTH = 10, 4
#: weight of the overall share in a suffix's share, and fewest labelled URLs of a suffix with its own share
SMOOTHING, MIN_LABELLED = 20.0, 20
#: parts of the labelled URLs whose shares are taken from the other parts
FOLDS = 5
#: suffixes whose statistics are sent to every task, at most; more are joined by a shuffle
BROADCAST_SUFFIXES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    """What stands behind the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(rules: list[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule ``(verdict, host, path)`` that fits; null where none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]

    def pick(values: list[str]) -> Column:
        return reduce(lambda c, x: c.when(x[0], x[1]), list(zip(fits, values, strict=True))[1:], F.when(fits[0], values[0]))

    return pick([h + p for _, h, p in ordered]), pick([v for v, _, _ in ordered])


def entropy(text: Column) -> Column:
    """Bits per character, from the runs of the sorted characters; 0 for an empty text."""
    n = F.length(text)

    def bits(run: Column) -> Column:
        return F.when(run > 1, run * F.log2(run)).otherwise(0.0)

    def add(state: Column, char: Column) -> Column:
        same = char == state["char"]
        return F.struct(char.alias("char"), F.when(same, state["run"] + 1).otherwise(1.0).alias("run"),
                        F.when(same, state["total"]).otherwise(state["total"] + bits(state["run"])).alias("total"))

    start = F.struct(F.lit("").alias("char"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))
    total = F.aggregate(F.array_sort(F.split(text, "")), start, add, lambda state: state["total"] + bits(state["run"]))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def _count(c: Column, pattern: str) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


LEXICAL = ["url_length", "host_length", "path_length", "query_length", "depth", "labels", "digit_ratio", "entropy", "params",
           "separators", "longest_label", "ends_slash", "has_extension", "secure"]
SUFFIX = ["suffix_urls", "suffix_blocked", "segment_blocked"]


def with_features(urls: DataFrame, url: str = "url") -> DataFrame:
    """``LEXICAL`` features, the host's last label (``suffix``) and that label with the first path segment (``segment``)."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    n = F.length(u)
    return (urls.withColumns({"url_length": n, "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query),
                              "depth": _count(path, "/"),
                              "labels": F.size(F.split(host, r"\.")), "digit_ratio": F.when(n > 0, _count(u, "[0-9]") / n).otherwise(0.0),
                              "entropy": entropy(u), "params": F.when(query == "", 0).otherwise(1 + _count(query, "&")),
                              "separators": _count(u, "[-_.%~+=]"), "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.length)),
                              "ends_slash": path.endswith("/").cast("int"), "has_extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int"),
                              "secure": u.startswith("https").cast("int"),
                              "suffix": F.regexp_extract(host, r"([^.]*)$", 1)})
            .withColumn("segment", F.concat_ws("/", "suffix", F.regexp_extract(path, r"^/([^/]*)", 1))))


def _small(table: DataFrame) -> DataFrame:
    """A table that was cut out of the lineage, marked for broadcast if it is small."""
    table = table.checkpoint()
    return F.broadcast(table) if table.count() <= BROADCAST_SUFFIXES else table


def _by_fold(counts: DataFrame, key: str) -> DataFrame:
    """``urls``, and ``labelled`` and ``blocked`` without the fold's own, of each ``key`` and fold; fold -1: of all."""
    own = counts.groupBy(key, "fold").agg(F.sum("urls").alias("urls"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    whole = own.groupBy(key).agg(*(F.sum(c).alias(c) for c in ("urls", "labelled", "blocked")))
    folds = whole.withColumn("fold", F.explode(F.sequence(F.lit(-1), F.lit(FOLDS - 1))))
    own = own.select(key, "fold", F.col("labelled").alias("own_labelled"), F.col("blocked").alias("own_blocked"))
    return folds.join(own, [key, "fold"], "left").select(
        key, "fold", "urls", *((F.coalesce(c, F.lit(0)) - F.coalesce("own_" + c, F.lit(0))).alias(c) for c in ("labelled", "blocked")))


def with_suffix_statistics(featured: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``SUFFIX`` from all rows; ``label`` is 1 (block), 0 (allow) or null."""
    fold = F.when(F.col("label").isNull(), -1).otherwise(F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int"))
    featured = featured.withColumn("fold", fold)
    counts = featured.groupBy("suffix", "segment", "fold").agg(F.count("*").alias("urls"), F.count("label").alias("labelled"), F.sum("label").alias("blocked")).checkpoint()
    overall = counts.agg((F.sum("blocked") / F.sum("labelled")).alias("share")).first()["share"]
    overall = 0.5 if overall is None else float(overall)
    rate = (F.col("blocked") + SMOOTHING * overall) / (F.col("labelled") + SMOOTHING)
    suffixes = _by_fold(counts, "suffix").select("suffix", "fold", F.log1p("urls").alias("suffix_urls"), rate.alias("suffix_blocked"))
    segments = _by_fold(counts, "segment").where(F.col("labelled") >= MIN_LABELLED).select("segment", "fold", rate.alias("segment_blocked"))
    return (featured.join(_small(suffixes), ["suffix", "fold"], "left").join(_small(segments), ["segment", "fold"], "left")
            .withColumn("segment_blocked", F.coalesce("segment_blocked", F.lit(overall))))


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=[*LEXICAL, *SUFFIX], outputCol="features")


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, order: str = "url") -> GBTClassificationModel:
    """Trees from rows with all features and ``label``: the first ``rows`` by hash."""
    sample = labelled.orderBy(F.xxhash64(order), order).limit(rows).select(*LEXICAL, *SUFFIX, F.col("label").cast("double").alias("label")).checkpoint()
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7).fit(assembler().transform(sample).select("features", "label"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url: str = "url", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (of the trees: share for block) of every row.

    URLs that a rule decides are the labelled ones.
    """
    ready(pages)
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = matching_rule(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "ruled": verdict}).withColumn("label", (F.col("ruled") == "block").cast("int"))
    featured = with_suffix_statistics(with_features(rows))
    kinds = {r["label"] for r in rows.where("label is not null").groupBy("label").count().collect()}
    columns = [F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", "method").alias("verdict")]
    if len(kinds) < 2:
        fixed = "block" if kinds == {1} else "allow"
        return rows.withColumn("method", F.lit(fixed)).select(*columns, F.lit(float(fixed == "block")).alias("score"))
    from pyspark.ml.functions import vector_to_array

    model = train(featured.where("label is not null"), train_rows)
    scored = model.transform(assembler().transform(featured)).withColumn("score", vector_to_array("probability")[1])
    return scored.withColumn("method", F.when(F.col("prediction") == 1.0, "block").otherwise("allow")).select(*columns, "score")
