"""Wikilinks: found by expressions over a note's lines, resolved by joins with the known paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines

#: A fenced block, from its first line to the next line that begins with a fence, or to the end.
_FENCED = r"(?ms)^\s*(?:```|~~~).*?(?:^\s*(?:```|~~~)[^\n]*|\z)"
#: An inline code span, or a link whose inside is group 1.
_SPAN_OR_LINK = r"`[^`]*(?:`|$)|\[\[(.*?)\]\]"


def links_in(content: Column) -> Column:
    """array<struct<target, alias, context>> of a note's text, in order."""
    outside = lines(F.regexp_replace(content, _FENCED, ""))
    candidates = F.filter(outside, lambda line: line.contains("[["))

    def of_line(line: Column) -> Column:
        inner = F.filter(F.regexp_extract_all(line, F.lit(_SPAN_OR_LINK), 1), lambda x: x != "")
        parsed = F.transform(
            inner,
            lambda x: F.struct(
                F.substring_index(F.substring_index(x, "|", 1), "#", 1).alias("target"),
                F.when(x.contains("|"), F.regexp_extract(x, r"\|(.*)$", 1)).alias("alias"),
                line.alias("context"),
            ),
        )
        return F.filter(parsed, lambda p: p["target"] != "")

    return F.flatten(F.transform(candidates, of_line))


def wikilinks(notes: DataFrame) -> DataFrame:
    """source_path, target, alias, context of every link in notes with path and content."""
    found = notes.where(F.col("content").contains("[[")).select(F.col("path").alias("source_path"), F.explode(links_in(F.col("content"))).alias("link"))
    return found.select("source_path", "link.target", "link.alias", "link.context")


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def resolve(links: DataFrame, paths: DataFrame) -> DataFrame:
    """links with target_path: the exact path, else the one beside the source, else the shortest of that name.

    Links that none of these finds are left out.  paths: a column path.
    """
    known = paths.select("path").distinct()
    file = F.element_at(F.split("path", "/"), -1)
    # an aggregate, so that a name which many folders have is reduced before it is shuffled
    first = F.min(F.struct(F.octet_length("path").alias("size"), "path"))
    shortest = known.groupBy(file.alias("file")).agg(first.alias("x")).select("file", F.col("x.path").alias("by_name"))
    dotted = F.regexp_replace("target", r"\\", "/")
    named = F.when(dotted.endswith(".md"), dotted).otherwise(F.concat(dotted, F.lit(".md")))
    folder = _parent(F.col("source_path"))
    asked = links.withColumns({"whole": named, "beside": F.when(folder != "", F.concat(folder, F.lit("/"), named))})
    asked = asked.withColumn("file", F.element_at(F.split("whole", "/"), -1))
    exact, near = known.select(F.col("path").alias("whole"), F.col("path").alias("by_path")), known.select(F.col("path").alias("beside"), F.col("path").alias("by_folder"))
    joined = asked.join(exact, "whole", "left").join(near, "beside", "left").join(shortest, "file", "left")
    target = F.coalesce("by_path", "by_folder", "by_name")
    return joined.withColumn("target_path", target).where("target_path IS NOT NULL").select("source_path", "target_path", "target", "alias", "context")


def extract_links(notes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Distinct source_path, target_path, context of the resolved links of ``notes``."""
    return resolve(wikilinks(notes), notes if paths is None else paths).select("source_path", "target_path", "context").distinct()
