"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is two aggregations by node; tables between rounds are written to the shared folder, so a lost executor
costs at most one round. Nothing goes to the driver but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistalake.llm.common import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``links(u, v)``; a component is named by its smallest node.

    Nulls and self-links are ignored; an empty table gives an empty result; repeated links count once.
    """
    edges = materialize(_tidy(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")), "links")
    before = None
    for _ in range(most_rounds):
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not mark.n or before == (mark.n, mark.s):
            break
        before = (mark.n, mark.s)
        old, edges = edges, materialize(_tidy(_small_star(_tidy(_large_star(edges)))), "links")
        release(old)
    else:
        raise RuntimeError("components did not converge")
    # At the fixed point every edge leads from a node to the smallest of its component.
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
