"""Presentation rounding shared by the registered queries (mirrors ``oracle_sql.RND``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mathcols import round_half_up


def rnd(c, d: int = 6) -> Column:
    """Round through DECIMAL(38,10), half away from zero, back to DOUBLE."""
    return round_half_up(c, d)


def present(df: DataFrame, digits: dict[str, int] | None = None, default: int = 6) -> DataFrame:
    """Cast float columns to DOUBLE and round every double column (``digits`` overrides)."""
    digits = digits or {}
    out = []
    for name, typ in df.dtypes:
        if typ in ("double", "float") or name in digits:
            out.append(rnd(F.col(name).cast("double"), digits.get(name, default)).alias(name))
        elif typ in ("int", "smallint", "tinyint"):
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
