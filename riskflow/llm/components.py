"""Connected components of a link table by alternating large-star and small-star steps.

Both steps are joins and minima over (node, neighbour) rows, so no component is ever gathered in one place: a
node's smallest neighbour is a partial aggregate, and handing it to the neighbours is a join that Spark can
split when a node is hot. Each round is checkpointed to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rounds after which a run is stopped as faulty; the steps end after about log(nodes) rounds
MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over rows (a > b): larger (or smaller) neighbours of a node move to its smallest neighbour."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("low"))
        joined = links.join(least, "a")
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of a link, component being its smallest node."""
    links = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct().checkpoint()
    mark = None
    for _ in range(MAX_ROUNDS):
        links = _star(_star(links, True), False).checkpoint()
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the star steps did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
