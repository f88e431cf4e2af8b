"""The link graph, as a table of source_path, target_path, context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import file_title
from ..sources.scratch import shared_folder

#: Rows of a result whose neighbours are looked up.
ROOTS = 5


def outgoing(links: DataFrame, path: str) -> DataFrame:
    return links.where(F.col("source_path") == path)


def backlinks(links: DataFrame, path: str) -> DataFrame:
    return links.where(F.col("target_path") == path)


def update_links(links: DataFrame, sources: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replaces the links of ``sources`` (a column path) by ``fresh``."""
    kept = remove_sources(links, sources)
    return kept.unionByName(fresh.select(links.columns)).dropDuplicates(["source_path", "target_path", "context"])


def remove_sources(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Links without those that begin in ``sources``; links that end there stay."""
    return links.join(sources.select(F.col("path").alias("source_path")).distinct(), "source_path", "left_anti").select(links.columns)


def stats(links: DataFrame) -> DataFrame:
    """node_count, edge_count."""
    nodes = links.select(F.explode(F.array("source_path", "target_path")).alias("path")).distinct()
    return nodes.agg(F.count("*").alias("node_count")).withColumn("edge_count", links.agg(F.count("*")).scalar())


def _step(frontier: DataFrame, pairs: DataFrame, seen: DataFrame, depth: int) -> DataFrame:
    """Nodes next to the frontier that weren't seen, at ``depth``."""
    near = frontier.join(pairs, frontier["path"] == pairs["here"]).select(F.col("there").alias("path")).distinct()
    return near.join(seen.select("path"), "path", "left_anti").withColumn("depth", F.lit(depth))


def _walk(start: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """path, depth of all nodes within ``depth`` steps, breadth first.

    Each level is checkpointed, to a folder that all nodes share, so a step
    reads the levels before it and doesn't work them out again; a walk ends when
    a level is empty.
    """
    spark = start.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    pairs = pairs.persist()
    try:
        levels = [start.select("path", F.lit(0).alias("depth"))]
        for d in range(1, depth + 1):
            level = _step(levels[-1], pairs, reduce(DataFrame.unionByName, levels), d).checkpoint()
            levels.append(level)
            if d < depth and level.isEmpty():
                break
        return reduce(DataFrame.unionByName, levels)
    finally:
        pairs.unpersist()


def _one(links: DataFrame, path: str) -> DataFrame:
    return links.sparkSession.range(1).select(F.lit(path).alias("path"))


def both_ways(links: DataFrame) -> DataFrame:
    """here, there: every link in both directions."""
    ends = F.array(F.struct(F.col("source_path").alias("here"), F.col("target_path").alias("there")), F.struct(F.col("target_path").alias("here"), F.col("source_path").alias("there")))
    return links.select(F.explode(ends).alias("e")).select("e.here", "e.there")


def expand_nodes(links: DataFrame, center: str, depth: int) -> DataFrame:
    """path, title, depth of the notes within ``depth`` links of ``center`` in either direction, itself included."""
    return _walk(_one(links, center), both_ways(links), depth).select("path", file_title(F.col("path")).alias("title"), "depth")


def expand_edges(links: DataFrame, center: str, depth: int) -> DataFrame:
    """The links with an end less than ``depth`` steps from ``center``: one, of the smallest context, for two notes."""
    inner = _walk(_one(links, center), both_ways(links), depth - 1).select("path") if depth > 0 else _one(links, center).where("false")
    at_source, at_target = inner.select(F.col("path").alias("source_path")), inner.select(F.col("path").alias("target_path"))
    touching = links.join(at_source, "source_path", "left_semi").unionByName(links.join(at_target, "target_path", "left_semi").select(links.columns))
    return touching.groupBy("source_path", "target_path").agg(F.min("context").alias("context"))


def propagate(links: DataFrame, start: str, depth: int) -> DataFrame:
    """path, depth of the notes that reach ``start`` by up to ``depth`` links, without itself."""
    pairs = links.select(F.col("target_path").alias("here"), F.col("source_path").alias("there"))
    return _walk(_one(links, start), pairs, depth).where("depth > 0")


def linked_notes(results: DataFrame, links: DataFrame, roots: int = ROOTS) -> DataFrame:
    """path, title, related_to: neighbours of the first ``roots`` results that aren't results themselves.

    results: path, rank (1 is best).  A note with several neighbours among them
    goes with the first.
    """
    top = results.where(F.col("rank") <= roots).select("path", "rank")
    near = top.join(both_ways(links), F.col("path") == F.col("here")).select(F.col("there").alias("path"), F.col("path").alias("related_to"), "rank")
    fresh = near.join(results.select("path").distinct(), "path", "left_anti")
    first = fresh.groupBy("path").agg(F.min(F.struct("rank", "related_to")).alias("x"))
    return first.select("path", file_title(F.col("path")).alias("title"), F.col("x.related_to").alias("related_to"))


def ranked(results: DataFrame) -> DataFrame:
    """Results (a few rows) with their rank by score."""
    return results.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "path", "start_line")))
