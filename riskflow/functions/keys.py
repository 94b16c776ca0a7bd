"""Card / user keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "NA"


def user_key(df: DataFrame, cols: Iterable[str]) -> Column:
    """B1: cast each *present* key column to string, null -> 'NA', join with '|'.

    ``coalesce`` runs before ``concat_ws`` because ``concat_ws`` silently skips nulls.
    """
    present = [c for c in cols if c in df.columns]
    if not present:
        raise ValueError(f"none of the key columns {list(cols)} is present")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in present]
    return parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)


def card_key(df: DataFrame) -> Column:
    """Card id of a raw/stream record: ``cc_num``, else ``user_id``, else 'unknown'."""
    opts = [F.col(c).cast("string") for c in ("cc_num", "user_id") if c in df.columns]
    return F.coalesce(*opts, F.lit("unknown"))
