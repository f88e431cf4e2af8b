"""Search responses as JSON and as text for people."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row

PREVIEW = 120


def to_json(results: DataFrame, linked: DataFrame | None = None, always: bool = True) -> str:
    """An object with results and linked_notes; ``always=False`` leaves an empty linked_notes out."""
    out: dict = {"results": [r.asDict(True) for r in results.collect()]}
    notes = [r.asDict(True) for r in linked.collect()] if linked is not None else []
    if notes or always:
        out["linked_notes"] = notes
    return json.dumps(out, indent=2, ensure_ascii=False)


def to_array(results: DataFrame) -> str:
    """A bare array, as for a search of one kind."""
    return json.dumps([r.asDict(True) for r in results.collect()], indent=2, ensure_ascii=False)


def to_text(results: list[Row], linked: list[Row] = (), context: dict | None = None) -> str:
    """Numbered hits with a preview, or with their lines where ``context`` has them by (path, start_line)."""
    out = []
    for i, r in enumerate(results, 1):
        out.append(f"{i}. [{r.match_type}] {r.path} (score: {r.score:.3f})")
        near = (context or {}).get((r.path, r.start_line))
        out += [f"   {x.line_no:>4} {x.line}" for x in near] if near else [f"   {r.chunk[:PREVIEW]}"]
        out.append("")
    if not results:
        out.append("  No results found.")
    if linked:
        out += ["  Linked notes:", *(f"    {n.path} (via {n.related_to})" for n in linked), ""]
    return "\n".join(out)
