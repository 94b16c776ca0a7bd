"""Train-only category codes and standardisation.

Fitted artifacts are small tables: ``category_map(column, value, code)`` and
``scaler(feature, mean, std)``. Applying them never refits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CATEGORICAL, TRAIN
from ..session import checkpoint_dir
from .ordering import global_positions

MISSING = "NA"
LITERAL_MAP_MAX = 64         # entries per column inlined as a map literal (a lookup scans the keys); above: join


def _utf8(s: str) -> bytes:
    """Sort key equal to Spark's binary string order."""
    return s.encode("utf-8")


def cat_value(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING))


def fit_categories(df: DataFrame, cols: Sequence[str] = CATEGORICAL, split_col: str = "split") -> DataFrame:
    """Codes 1..K for the distinct TRAIN values of each present column, in code-point order.

    NA is an ordinary value here (it gets its own code when train contains nulls). One aggregate finds the distinct
    (column, value) pairs; their positions in the global (column, value) order, less those of the columns before,
    are the codes. Nothing but one row for each column reaches the driver, however many values there are.
    """
    train = df.where(F.col(split_col) == TRAIN)
    present = [c for c in cols if c in df.columns]
    spark = df.sparkSession
    if not present:
        return spark.createDataFrame([], "column string, value string, code int")
    checkpoint_dir(spark)
    pairs = reduce(DataFrame.unionByName,
                   [train.select(F.lit(c).alias("column"), cat_value(c).alias("value")) for c in present]).distinct().checkpoint()
    placed = global_positions(pairs, ["column", "value"], "_at")
    first = {r["column"]: int(r["n"]) for r in pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, total = F.lit(0), 0
    for c in sorted(first, key=_utf8):
        start = F.when(F.col("column") == c, total).otherwise(start)
        total += first[c]
    return placed.select("column", "value", (F.col("_at") - start + 1).cast("int").alias("code")).checkpoint()


def collect_maps(cat_map: DataFrame) -> dict[str, dict[str, int] | None]:
    """Fitted maps of the small columns (at most ``LITERAL_MAP_MAX`` codes) to the driver; a larger
    column maps to ``None`` and is applied by a join (``apply_categories`` with ``cat_map``)."""
    sizes = {r["column"]: int(r["n"]) for r in cat_map.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = [c for c, n in sizes.items() if n <= LITERAL_MAP_MAX]
    out: dict[str, dict[str, int] | None] = {c: None for c, n in sizes.items() if n > LITERAL_MAP_MAX}
    if small:
        for r in cat_map.where(F.col("column").isin(small)).collect():
            out.setdefault(r["column"], {})[r["value"]] = int(r["code"])
    return out


def code_of(c: str, mapping: dict[str, int]) -> Column:
    """E2 for one column: mapped code, 0 when unseen in train."""
    if not mapping:
        return F.lit(0)
    kv = []
    for k in sorted(mapping):
        kv += [F.lit(k), F.lit(int(mapping[k]))]
    return F.coalesce(F.try_element_at(F.create_map(*kv), cat_value(c)), F.lit(0))


def apply_categories(df: DataFrame, maps: dict[str, dict[str, int] | None], cols: Sequence[str] | None = None,
                     cat_map: DataFrame | None = None) -> DataFrame:
    """Add ``{col}_code`` for every fitted column: an inlined map lookup (no join) for small
    maps, an equi join on the fitted table for columns whose map is ``None`` (too large to inline)."""
    cols = list(cols) if cols is not None else list(maps)
    big = [c for c in cols if c in maps and maps[c] is None]
    if big and cat_map is None:
        raise ValueError(f"columns {big} need the fitted category table (cat_map) to be joined")
    out = df.select("*", *[code_of(c, maps.get(c) or {}).cast("int").alias(f"{c}_code") for c in cols if c not in big])
    if big:
        out = apply_categories_join(out, cat_map, big)
        out = out.select(*df.columns, *[F.col(f"{c}_code").cast("int").alias(f"{c}_code") for c in cols])
    return out


def apply_categories_join(df: DataFrame, cat_map: DataFrame, cols: Sequence[str]) -> DataFrame:
    """E2 for maps too large to inline: equi left join per column, Spark chooses the strategy."""
    out = df
    for c in cols:
        m = cat_map.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"{c}_code"))
        out = (out.join(m, cat_value(c) == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
                  .withColumn(f"{c}_code", F.coalesce(F.col(f"{c}_code"), F.lit(0))))
    return out


def fit_scaler(df: DataFrame, cols: Sequence[str], split_col: str = "split", eps: float | None = None) -> DataFrame:
    """Per-feature mean and population std over TRAIN rows, std 0 -> 1 (or ``std + eps``).

    One aggregate pass; the 1-row result is reshaped to ``(feature, mean, std)``.
    """
    train = df.where(F.col(split_col) == TRAIN)
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        aggs += [F.avg(v).alias(f"m_{c}"), F.stddev_pop(v).alias(f"s_{c}")]
    row = train.agg(*aggs)
    stack = ", ".join(f"'{c}', `m_{c}`, `s_{c}`" for c in cols)
    long = row.selectExpr(f"stack({len(cols)}, {stack}) as (feature, mean, std)")
    if eps is None:
        std = F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))
    else:
        std = F.col("std") + F.lit(eps)
    return long.select("feature", "mean", std.alias("std"))


def collect_scaler(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    return {r["feature"]: (float(r["mean"]), float(r["std"])) for r in scaler.collect()}


def apply_scaler(df: DataFrame, stats: dict[str, tuple[float, float]], out_type: str = "float") -> DataFrame:
    """``(x - mean) / std`` on the fitted numeric columns only; codes untouched."""
    repl = {c: ((F.col(c).cast("double") - F.lit(m)) / F.lit(s)).cast(out_type).alias(c) for c, (m, s) in stats.items()}
    return df.select(*[repl.get(c, F.col(c)) for c in df.columns])


def assemble(cols: Sequence[str], out_type: str = "float") -> Column:
    """E5: feature vector, numeric block then code block, as ``ARRAY<FLOAT>``."""
    return F.array(*[F.col(c).cast(out_type) for c in cols])
