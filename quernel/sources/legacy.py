"""Importers of an older index's JSON files: vectors with their metadata, and content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_META = "path:string,title:string,tags:string,heading:string,start_line:int,end_line:int,text:string"
_VECTORS = f"entries array<struct<vector:array<float>,metadata:struct<{_META}>>>"


def json_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The vectors table (schemas.VECTORS) of a JSON file with entries of vector and metadata."""
    entries = spark.read.schema(_VECTORS).option("multiLine", True).json(path).select(F.explode("entries").alias("e"))
    return entries.select("e.metadata.path", "e.metadata.title", "e.metadata.tags", "e.metadata.heading", "e.metadata.start_line", "e.metadata.end_line", "e.metadata.text", F.lit(0).alias("body_line_offset"), F.col("e.vector").alias("embedding"))


def json_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, content_hash of a JSON object of paths to hashes; none if it can't be read as one."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("path", "content_hash"))
