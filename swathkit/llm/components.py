"""Connected components of a link table by large-star and small-star rounds.

Each round is a min per node and a join, so a node with very many links costs partial aggregation and a
join that adaptive execution can split; the links of a round are written to the shared folder, which cuts
lineage. Nothing is collected but one checksum per round. The number of rounds grows with the logarithm of
the longest path.

Links with a null end, and of a node to itself, link nothing and are left out; repeated links count once, whichever way
round; a node without another link is not returned. An empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathkit.llm import common


def _checksum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller) neighbours of each node, and itself, on the smallest of them."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    if large:
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root of every node that has a link; links has non-null columns u and v, root is the smallest node."""
    now = common.materialize(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    seen = _checksum(now)
    while seen[0]:
        now = common.materialize(_star(_star(now, large=True), large=False), "links")
        if (after := _checksum(now)) == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
