"""Connected components of a table of links, by alternating large and small stars.

Every round replaces links by links to the least neighbour, which keeps the components and
ends in stars around the least id of each.  A round is two aggregations and two joins on
ids; nothing is collected, and frequent ids are pre-aggregated before the shuffle.  Beyond ``HOT`` links
the least neighbours are written before links are joined to them: both sides are then dealt out anew, and Spark can split
the links of one id (the centre of a large star) over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

HOT = 1 << 16


def _large_star(links: DataFrame, hot: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(table(least, "least") if hot else least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame, hot: bool) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    least = table(least, "least") if hot else least
    pairs = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pairs.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least id reachable, for every id in ``links`` (u, v) that is not itself the least."""
    state = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = table(links.where("u <> v").select("u", "v").distinct(), "links")
    before = None
    while before != (before := state(now)):
        hot = before[0] > HOT
        now = table(_small_star(_large_star(now, hot), hot), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
