"""Adapters from the driver's test tables to the raw-transaction schema.

They only rename / derive columns into the schema the jobs expect; no job work happens here.
Dimension joins are left to Spark's size-checked join selection, except ``nation`` whose size is
fixed (25 rows) and is broadcast explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timecols import epoch_seconds_ntz
from .tables import read_table


def _geo(key, mult_lat: int, mult_long: int, k=None):
    """Deterministic coordinates in degrees derived from an integer key (adapter rule)."""
    lat_in = key * F.lit(mult_lat) + (k * F.lit(37) if k is not None else F.lit(0))
    long_in = key * F.lit(mult_long) + (k * F.lit(53) if k is not None else F.lit(0))
    lat = F.lit(25.0) + F.pmod(lat_in, F.lit(2400)).cast("double") / F.lit(100.0)
    lon = F.lit(-124.0) + F.pmod(long_in, F.lit(5700)).cast("double") / F.lit(100.0)
    return lat, lon


def tx_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transactions from ``events`` (card = user_id) with customer segment and nation name."""
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    k = F.get_json_object("props", "$.k").cast("bigint")
    j = (e.join(c, e.user_id == c.c_custkey, "left")
          .join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey, "left"))
    lat, lon = _geo(F.col("user_id"), 7919, 104729)
    mlat, mlon = _geo(F.col("user_id"), 7919, 104729, k)
    return j.select(
        F.col("user_id").cast("string").alias("cc_num"),
        epoch_seconds_ntz("ts").alias("unix_time"),
        F.col("value").alias("amt"),
        lat.alias("lat"), lon.alias("long"),
        mlat.alias("merch_lat"), mlon.alias("merch_long"),
        F.col("event_type").alias("category"),
        F.col("c_mktsegment").alias("gender"),
        F.col("n_name").alias("state"),
        F.when((F.col("event_type") == "error") & (k >= 90), 1).otherwise(0).alias("is_fraud"),
        F.col("event_id").alias("tie"),
    )


def tx_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger raw-transaction table: lineitem joined to orders (card = o_custkey).

    ``(l_orderkey, l_linenumber)`` is not unique in the test data, so ``tie`` is a struct that also
    carries part, supplier and price; rows equal in all of these are equal in every feature input.
    """
    li = read_table(spark, sf_dir, "lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"])
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    lat, lon = _geo(F.col("o_custkey"), 7919, 104729)
    mlat, mlon = _geo(F.col("o_custkey"), 7919, 104729, F.pmod(F.col("l_partkey"), F.lit(100)))
    return j.select(
        F.col("o_custkey").cast("string").alias("cc_num"),
        epoch_seconds_ntz("l_shipdate").alias("unix_time"),
        F.col("l_extendedprice").alias("amt"),
        lat.alias("lat"), lon.alias("long"),
        mlat.alias("merch_lat"), mlon.alias("merch_long"),
        F.col("o_orderpriority").alias("category"),
        F.col("l_linestatus").alias("gender"),
        F.col("o_orderstatus").alias("state"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09), 1).otherwise(0).alias("is_fraud"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("tie"),
    )


def orders_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tie-heavy time column for split tests: many orders share one ``o_orderdate``."""
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"])
    return o.select(F.col("o_orderkey").alias("tie"), epoch_seconds_ntz("o_orderdate").alias("unix_time"))
