"""Fusion of vector and full-text results, and filters on what comes out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Search
from ..functions.text import starts_with_any


def fts_results(hits: DataFrame) -> DataFrame:
    """Full-text hits (path, title, score) as search results."""
    empty = F.lit("")
    return hits.select("path", "title", empty.alias("chunk"), "score", F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.array().cast("array<string>").alias("tags"), empty.alias("heading"), F.lit("fts").alias("match_type"))


def merge(semantic: DataFrame, fts: DataFrame, limit: int, weights: Search = Search(), digits: int | None = None) -> DataFrame:
    """The ``limit`` best of both: an outer join on path of chunks and documents.

    Full-text scores are over their maximum, 1 at least.  A chunk whose document
    was found too has the weighted sum; one without keeps its similarity; a
    document without chunks stands for itself.
    """
    top = fts.agg(F.greatest(F.lit(1.0), F.coalesce(F.max("score"), F.lit(0.0)))).scalar()
    share = fts.select("path", F.col("title").alias("fts_title"), (F.col("score") / top).alias("share"))
    chunks = semantic.dropDuplicates(["path", "start_line"])
    both = chunks.withColumn("seen", F.lit(True)).join(share, "path", "full")
    chunk, document = F.col("seen").isNotNull(), F.col("share").isNotNull()
    fused = F.when(chunk & document, weights.vector_weight * F.col("score") + weights.fts_weight * F.col("share")).when(chunk, F.col("score")).otherwise(weights.fts_weight * F.col("share"))
    kind = F.when(chunk & document, "hybrid").when(chunk, F.col("match_type")).otherwise("fts")
    out = both.select(
        "path", F.coalesce("title", "fts_title").alias("title"), F.when(chunk, F.col("chunk")).otherwise("[FTS match]").alias("chunk"),
        (F.round(fused, digits) if digits else fused).alias("score"), F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("heading", F.lit("")).alias("heading"), kind.alias("match_type"),
    )
    return out.orderBy(F.desc("score"), "path", "start_line").limit(limit)


def exclude(results: DataFrame, prefixes: list[str]) -> DataFrame:
    return results.where(~starts_with_any(F.col("path"), prefixes))


def threshold(results: DataFrame, least: float) -> DataFrame:
    return results.where(F.col("score") >= least)


def since(results: DataFrame, notes: DataFrame, date: str) -> DataFrame:
    """Results whose note (path, modified) changed on or after a day, YYYY-MM-DD in UTC; those without a note go."""
    import datetime

    day = datetime.datetime.strptime(date, "%Y-%m-%d").replace(tzinfo=datetime.UTC)
    recent = notes.where(F.unix_seconds("modified") >= int(day.timestamp())).select("path")
    return results.join(recent, "path", "left_semi").select(results.columns)
