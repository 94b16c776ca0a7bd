"""The batch job: raw transactions -> processed, split, encoded, scaled table.

Jobs: (1) hot-card check + causal features, materialised once; (2) exact split cutoffs;
(3) train-only category codes and scaler; (4) the apply projection. Only fitted tables
(categories, scaler rows, two cutoffs) reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.causal import CHUNK_ROWS, HOT_ROWS
from ..operators.encode import apply_categories, collect_maps, collect_scaler, fit_categories, fit_scaler, apply_scaler
from ..operators.features import causal_features, with_user
from ..operators.split import Cutoffs, cutoffs, label_split
from ..schema import DEFAULT_SPEC, TEST_SIZE, VAL_SIZE, FeatureSpec


@dataclass
class Processed:
    table: DataFrame                 # one row per transaction: keys, y, split, raw + scaled features
    features: DataFrame              # unscaled causal features with split
    cut: Cutoffs
    category_map: DataFrame
    scaler: DataFrame
    maps: dict
    stats: dict
    spec: FeatureSpec                # what the raw features are made by, and the categories
    representation: str = "raw"      # "triple_pca": the numeric block (the keys of ``stats``) is the projections


def features_table(raw: DataFrame, spec: FeatureSpec = DEFAULT_SPEC, hot_rows: int = HOT_ROWS,
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """B1 + C1-C8 on raw transactions; ``amt_raw`` keeps the unscaled amount for feeds and alerts."""
    x = with_user(raw).withColumn("amt_raw", F.col("amt").cast("double"))
    return causal_features(x, spec, hot_rows=hot_rows, chunk_rows=chunk_rows)


def build_processed(raw: DataFrame, spec: FeatureSpec = DEFAULT_SPEC, test_size: float = TEST_SIZE,
                    val_size: float = VAL_SIZE, materialize: bool = True, hot_rows: int = HOT_ROWS,
                    chunk_rows: int = CHUNK_ROWS, representation: str = "raw") -> Processed:
    """Full ETL. ``materialize`` writes the feature table as parquet under ``spark.checkpoint.dir``
    so the cutoffs, fits and final projection read it (pruned) instead of recomputing the windows.
    """
    if representation not in ("raw", "triple_pca"):
        raise ValueError(f"unknown representation {representation!r} (raw | triple_pca)")
    feats = features_table(raw, spec, hot_rows, chunk_rows)
    if materialize:
        # a parquet table in the shared checkpoint folder cuts the lineage like checkpoint() and
        # keeps column pruning and filter pushdown for the passes below (cutoffs read one column)
        from ..session import scratch_path
        path = scratch_path(feats.sparkSession, "features")
        feats.write.parquet(path)
        feats = feats.sparkSession.read.parquet(path)
    cut = cutoffs(feats, "unix_time", test_size, val_size)
    feats = label_split(feats, cut).withColumn("y", F.col("is_fraud").cast("int"))
    return fit_processed(feats, cut, spec, representation)


def fit_processed(feats: DataFrame, cut: Cutoffs, spec: FeatureSpec, representation: str = "raw") -> Processed:
    """Jobs (3) and (4) on features with their split and label; another representation starts here, from the same features."""
    num = spec.numeric()
    if representation == "triple_pca":
        from ..operators.pca import triple_pca
        feats, num = triple_pca(feats, num)
    cat_map = fit_categories(feats, spec.categorical)
    maps = collect_maps(cat_map)
    scaler = fit_scaler(feats, num)
    stats = collect_scaler(scaler)
    coded = apply_categories(feats, maps, [c for c in spec.categorical if c in feats.columns], cat_map)
    table = apply_scaler(coded, stats)
    return Processed(table, feats, cut, cat_map, scaler, maps, stats, spec, representation)


def feature_columns(p: Processed, num: list[str] | None = None) -> list[str]:
    num = num if num is not None else list(p.stats)
    return num + [f"{c}_code" for c in p.spec.categorical if f"{c}_code" in p.table.columns]
