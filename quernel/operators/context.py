"""Lines around a hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines


def context_window(hits: DataFrame, notes: DataFrame, around: int) -> DataFrame:
    """path, start_line, line_no, line, is_match: each hit's lines and ``around`` more on either side.

    hits: path, start_line, end_line, counted from 1 within the whole note (a
    body's lines plus its body_line_offset); hits on line 0 have no context.
    """
    first = F.greatest(F.lit(1), F.col("start_line") - around)
    last = F.least(F.size("all"), F.col("end_line") + around)
    texts = notes.select("path", lines(F.col("content")).alias("all"))
    spans = hits.where("start_line > 0").select("path", "start_line", "end_line").distinct().join(texts, "path")
    cut = spans.select("path", "start_line", "end_line", first.alias("first"), F.slice("all", first, F.greatest(F.lit(0), last - first + 1)).alias("part"))
    rows = cut.select("path", "start_line", "end_line", "first", F.posexplode("part").alias("n", "line"))
    number = F.col("first") + F.col("n")
    return rows.select("path", "start_line", number.alias("line_no"), "line", number.between(F.col("start_line"), F.col("end_line")).alias("is_match"))
