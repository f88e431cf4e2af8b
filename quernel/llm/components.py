"""Connected components of links, as tables: minimum labels by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, spread_join, stored


#: Links of a file; links of a node beyond which they are dealt into parts.
EDGES, HUB = 250_000, 512


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``links``.

    Large-star and small-star steps in turn: every node's larger, then its other
    neighbours are hung below the smallest.  The smallest neighbour is found by
    an aggregate and joined back, in parts for a node with many links.  Each
    round is a written table.
    """
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    # links don't grow in number from here on
    n = edges.count()
    files = max(4, -(-n // EDGES))

    def with_least(each: DataFrame, least: DataFrame) -> DataFrame:
        return spread_join(each, least, "u", "v", HUB) if 2 * n > HUB else each.join(least, "u")

    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(files)
        # now each edge leads to a smaller node
        down = stored(large, "edges")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = with_least(down, least).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = stored(small.select("e.u", "e.v").where("u <> v").distinct().coalesce(files), "edges")
        sign = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        drop_stored(edges, down)
        edges = after
        if tuple(sign) == before:
            break
        before = tuple(sign)
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    out = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).coalesce(files), "components")
    drop_stored(edges)
    return out
