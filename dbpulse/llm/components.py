"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two joins and two map-side combined aggregates over the links, so no task
and no driver ever holds a whole component. A star's centre may have any number of
neighbours: the aggregate keeps one row for it and the join's partitions can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("low"))
    return (
        both.join(least, "src")
        .filter("dst > src")
        .select(F.col("dst").alias("src"), F.least("low", "src").alias("dst"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("low"))
    joined = down.join(least, "src")
    return (
        joined.filter("dst != low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        .unionByName(least.select("src", F.col("low").alias("dst")))
        .distinct()
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(src, dst)`` of longs, any direction, repeats allowed -> ``(node, component)``.

    Only nodes that have a link to another node come back; ``component`` is the smallest
    node reachable. Self links and links with a null end are ignored. An empty table gives
    an empty table.
    """
    links = edges.filter("src != dst").select(F.col("src").cast("long"), F.col("dst").cast("long"))
    links = cut_lineage(links.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    mark = F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")
    before = links.agg(*mark).first()
    for _ in range(max_rounds):
        links = cut_lineage(_small_star(_large_star(links)))
        after = links.agg(*mark).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    stars = links.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    centres = links.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return stars.unionByName(centres)
