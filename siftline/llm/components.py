"""Connected components of a graph given by its links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import discard, materialise, row_count


def _least_neighbour(links: DataFrame) -> DataFrame:
    """u, v with m, the least node among u and its neighbours. A hub's minimum is aggregated before
    the shuffle and joined back, so no task gathers a hub's neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of ``links`` (u, v).

    Large stars hang every greater neighbour on a node's minimum, small stars the lesser ones; a
    few rounds leave one star a component. Every round is written out, and then the round before it goes."""
    stars = materialise(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        met = _least_neighbour(down)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        before, stars = stars, materialise(small.where("u != v").distinct())
        discard(before)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    if not row_count(stars):
        return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
