"""Line dedup by winnowing over line hashes (operator 1), in DataFrame operations only.

A window is a shortest stretch of whole lines with at least ``MIN_CHARS`` characters, line ends included: one runs
forward from every line and one back from every line. Its smallest line hash is its fingerprint. Equal windows have
equal fingerprints, so a fingerprint that is met at one place only ends the matter for its windows. The places of
the others are joined: the match at a fingerprint is extended both ways to the borders of its window (128 bits of
hash over all its lines), and the first place in (doc_id, line) order is kept. Every line of a later place goes.

A line therefore goes exactly if it lies in a run of consecutive lines of ``MIN_CHARS`` characters or more that
also occurs earlier: of such a run, the windows forward and back cover every line. A frequent run is never expanded
into pairs; each place meets one row, the first place.

Defined results: null text stays null, empty text stays empty. Rows equal in doc_id and text are one document and get
the same result; rows equal in doc_id alone are ordered by their text's hash, null ids come first. A run that overlaps
its own earlier occurrence (A A A) keeps the lines before it. A text of which every line goes becomes empty. Empty
table: empty result. Very long texts: their lines are rows. Extra columns are kept, whatever their names; only the two
counts that the operator returns, ``n_lines`` and ``n_dropped``, replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, stashed

#: characters (with one for each line's end) that a repeated run holds at least
MIN_CHARS = 50


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def minima(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """The selected places: document (``id``, ``th``), line ``at``, fingerprint ``a``, and the windows with that minimum
    (first and last line, hashes ``w1``, ``w2``): at most 2 * ``min_chars``, as each begins or ends that near to it."""
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = (docs.select(F.col(id_col).alias("id"), _text_hash(F.col(text).cast("string")).alias("th"), F.posexplode(F.split(own, "\n")).alias("line", "s"))
             .select("id", "th", "line", F.xxhash64("s").alias("h"), F.xxhash64(F.lit("second"), F.col("s")).alias("g"), (F.length("s") + 1).cast("long").alias("n")))
    lines = lines.repartition("id", "th").groupBy("id", "th", "line").agg(F.first("h").alias("h"), F.first("g").alias("g"), F.first("n").alias("n"))
    doc = Window.partitionBy("id", "th")
    by_line = doc.orderBy("line")
    lines = lines.withColumn("end", F.sum("n").over(by_line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("n"))
    forward = doc.orderBy("start").rangeBetween(0, min_chars - 1)          # lines that start within min_chars of this one's start
    back = doc.orderBy("end").rangeBetween(-(min_chars - 1), 0)            # lines that end within min_chars of this one's end

    def seen(frame):
        least = F.min(F.struct("h", (-F.col("line")).alias("negative"))).over(frame)
        return F.struct(F.min("line").over(frame).alias("first"), F.max("line").over(frame).alias("last"),
                        (F.max("end").over(frame) - F.min("start").over(frame)).alias("chars"), least["h"].alias("a"), (-least["negative"]).alias("at"),
                        F.xxhash64(F.collect_list("h").over(frame)).alias("w1"), F.xxhash64(F.collect_list("g").over(frame)).alias("w2"))

    both = lines.select("id", "th", seen(forward).alias("f"), seen(back).alias("b"))
    same = (F.col("f.first") == F.col("b.first")) & (F.col("f.last") == F.col("b.last"))
    windows = F.when(same, F.array("f")).otherwise(F.array("f", "b"))
    found = both.select("id", "th", F.explode(windows).alias("w")).where(F.col("w.chars") >= min_chars)
    return (found.groupBy("id", "th", F.col("w.a").alias("a"), F.col("w.at").alias("at"))
            .agg(F.collect_list(F.struct("w.first", "w.last", "w.w1", "w.w2")).alias("windows")))


def repeated_lines(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """``id``, ``th`` and ``gone``: the numbers of a document's lines that lie in later repeats."""
    place = F.struct("id", "th", "first")
    with stashed(minima(docs, id_col, text, min_chars), "line-minima") as selected:
        shared = selected.groupBy("a").agg(F.count("*").alias("places")).where("places > 1").select("a").checkpoint()
        joined = selected.join(shared, "a", "left_semi").select("a", "id", "th", F.inline("windows"))
        with stashed(joined, "line-matches") as places:
            key = ["a", "w1", "w2"]
            first = places.groupBy(key).agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1").select(*key, "kept").checkpoint()
            later = places.join(first, key).where(~place.eqNullSafe(F.col("kept")))
            gone = later.select("id", "th", F.explode(F.sequence("first", "last")).alias("line"))
            return gone.groupBy("id", "th").agg(F.collect_set("line").alias("gone")).checkpoint()


def drop_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with later repeats cut out of ``text``, and ``n_lines`` and ``n_dropped`` (long)."""
    ready(docs)
    gone = repeated_lines(docs, id_col, text, min_chars).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("gone").alias("__gone"))
    source = docs.drop("n_lines", "n_dropped")
    joined = source.join(gone, source[id_col].eqNullSafe(F.col("__id")) & (_text_hash(source[text].cast("string")) == F.col("__th")), "left")
    lines = F.split(F.col(text).cast("string"), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    cut = F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")
    return joined.select(*(F.when(F.col("__gone").isNull(), source[c]).otherwise(cut).alias(c) if c == text else source[c] for c in source.columns),
                         F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
                         F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"))
