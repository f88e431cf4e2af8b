"""Chunks of notes: sections by headings, packed to a token budget.

A body is first cut into sections, each with its trail of headings, by native
expressions' Python counterpart over Arrow batches; then each section's lines
are packed.  A chunk is never larger than the budget unless a single line is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..schemas import CHUNKS

_HEADING = re.compile(r"\s*(#{1,6})(?: (.*))?$", re.DOTALL)
_WIDE = re.compile(r"[^\x00-⿿]")


def line_cost(line: str) -> int:
    """The token estimate of functions.text.estimate_tokens."""
    wide = len(_WIDE.findall(line))
    return wide * 10 // 15 + (len(line) - wide) // 4 + 1


def body_lines(body: str) -> list[str]:
    found = [line.removesuffix("\r") for line in body.split("\n")]
    return found[:-1] if found[-1] == "" else found


def sections(found: list[str], title: str) -> Iterator[tuple[int, int, str | None]]:
    """(first line, line after the last, heading trail) of each section."""
    begin, trail, label = 0, [], None
    for n, line in enumerate(found):
        if m := _HEADING.fullmatch(line):
            if n > begin:
                yield begin, n, label
            depth = len(m[1])
            trail = [(d, t) for d, t in trail if d < depth] + [(depth, (m[2] or "").strip())]
            begin, label = n, " > ".join([title, *(t for _, t in trail)])
    if begin < len(found):
        yield begin, len(found), label


def chunks_of(body: str, title: str, budget: int) -> list[tuple[str, int, int, str | None]]:
    """(text, first line, last line, heading) of each chunk, lines counted from 1 within the body."""
    out, found = [], body_lines(body)
    for begin, end, label in sections(found, title):
        costs = [line_cost(x) for x in found[begin:end]]
        cuts, spent, filled = [begin], 0, False
        for n, cost in enumerate(costs, begin):
            if filled and spent + cost > budget:
                cuts.append(n)
                spent, filled = 0, False
            spent += cost
            filled = filled or bool(found[n].strip())
        for a, b in zip(cuts, [*cuts[1:], end]):
            if text := "\n".join(found[a:b]).strip():
                out.append((text, a + 1, b, label))
    return out


def chunk_notes(notes: DataFrame, budget: int = 400) -> DataFrame:
    """Chunks of notes with columns path, title, tags (comma-separated), body and body_line_offset."""
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    types = [pa.string()] * 3 + [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for ix, (text, a, b, label) in enumerate(chunks_of(r["body"] or "", r["title"] or "", budget)):
                    rows.append((r["path"], r["title"], r["tags"], ix, text, a, b, label, r["body_line_offset"]))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)

    return notes.select("path", "title", "tags", "body", "body_line_offset").mapInArrow(run, CHUNKS)
