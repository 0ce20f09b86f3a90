"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellisgraph.llm.common import saved


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has a link.

    Large-star and small-star rounds over the link table (Kiveris et al. 2014) until only stars are left. Each round's
    links are written to the shared folder, so neither lineage nor driver memory grows; the driver sees two numbers.
    A hub's links are combined before the shuffle (min) and its join side can be split, as the other side has one row.
    """
    one = F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")
    links = links.select(*one).where("u <> v")
    edges = saved(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state or not state[0]:
            break
        before = state
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = saved(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m").toDF("u", "v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    stars = edges.groupBy("u").agg(F.min("v").alias("component"))
    return stars.toDF("node", "component").union(stars.select("component").distinct().select(F.col("component").alias("node"), "component"))
