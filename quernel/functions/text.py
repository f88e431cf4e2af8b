"""Text functions: hashes, titles, token estimates, headings, search tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Search tokens of this many bytes or more are dropped.
TOKEN_BYTES = 40


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def file_title(path: Column) -> Column:
    """The last segment of a path without .md at its end."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.md)+$", "")


def note_title(own: Column, path: Column) -> Column:
    return F.coalesce(own, file_title(path))


def csv_tags(tags: Column) -> Column:
    """The parts of a comma-separated list, without empty ones."""
    return F.filter(F.split(tags, ","), lambda t: t != "")


def estimate_tokens(text: Column) -> Column:
    """About how many model tokens a line has: wide characters count two thirds, others a quarter."""
    wide = F.length(F.regexp_replace(text, r"[\x{0}-\x{2FFF}]", ""))
    whole = lambda c, by: F.floor(c / by)
    return (whole(wide * 10, 15) + whole(F.length(text) - wide, 4) + 1).cast("int")


HEADING = r"^\s*(#{1,6})(?: (.*))?$"


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line, else 0."""
    return F.length(F.regexp_extract(line, HEADING, 1))


def heading_text(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, HEADING, 2))


def lines(text: Column) -> Column:
    """A text's lines; a line end at the text's end begins no further line."""
    parts = F.split(text, r"\r?\n")
    return F.when(text == "", F.array().cast("array<string>")).when(
        F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)
    ).otherwise(parts)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; overlong ones are null and keep their place."""
    words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.transform(words, lambda t: F.when(F.octet_length(t) < TOKEN_BYTES, F.lower(t)))


def kept_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: t.isNotNull())


def embedding_input(heading: Column, text: Column) -> Column:
    return F.when(heading.isNotNull(), F.concat(heading, F.lit("\n\n"), text)).otherwise(text)


def starts_with_any(path: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def has_all(tags: Column, wanted: list[str]) -> Column:
    out = F.lit(True)
    for t in wanted:
        out = out & F.array_contains(tags, t)
    return out
