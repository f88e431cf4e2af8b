"""Frontmatter of notes: a YAML block between two lines of three dashes at the top."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    import yaml
except ImportError:  # a reader of plain keys and lists stands in
    yaml = None

_LIST = T.ArrayType(T.StringType())
FRONTMATTER = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("tags", _LIST),
        T.StructField("aliases", _LIST),
        T.StructField("summary", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("body_start", T.IntegerType()),
        T.StructField("body", T.StringType()),
        T.StructField("body_line_offset", T.IntegerType()),
    ]
)
_OPEN = re.compile(r"\A[^\S\n]*---[^\S\n]*\r?\n")
_CLOSE = re.compile(r"^[^\S\n]*---[^\S\n]*(?:\r?\n|\Z)", re.MULTILINE)
#: A summary is cut after the character that reaches this many bytes.
SUMMARY_BYTES = 250


def _simple(block: str) -> dict:
    out: dict = {}
    key = None
    for line in block.splitlines():
        if (m := re.match(r"\s+-\s*(.*)|-\s+(.*)", line)) and key:
            out[key] = [*(out[key] or []), (m[1] or m[2] or "").strip().strip("'\"")]
        elif m := re.match(r"(\w+):\s*(.*)", line):
            key, value = m[1], m[2].strip()
            if value.startswith("[") and value.endswith("]"):
                out[key] = [v.strip().strip("'\"") for v in value[1:-1].split(",") if v.strip()]
            else:
                out[key] = value.strip("'\"") or None
    return out


def _fields(block: str) -> dict:
    """The known keys; nothing of a block in which any has a value of the wrong kind."""
    try:
        raw = (yaml.safe_load(block) if yaml else _simple(block)) or {}
    except Exception:  # noqa: BLE001  a block that isn't YAML counts as empty
        return {}
    texts = lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)
    if not isinstance(raw, dict):
        return {}
    tags, aliases = raw.get("tags"), raw.get("aliases", [])
    plain = all(raw.get(k) is None or isinstance(raw[k], str) for k in ("title", "summary", "type"))
    if not plain or not texts(aliases) or not (tags is None or isinstance(tags, str) or texts(tags)):
        return {}
    listed = [] if tags is None else [tags] if isinstance(tags, str) else tags
    return {k: raw.get(k) for k in ("title", "summary", "type")} | {"aliases": aliases, "tags": [t.lower() for t in listed]}


def first_paragraph(body: str) -> str | None:
    """The first run of lines that are neither blank nor headings, as one line."""
    runs = re.split(r"\n(?=\s*(?:#|\n|\Z))", "\n" + body.replace("\r\n", "\n"))
    for run in runs:
        kept = [s for line in run.split("\n") if (s := line.strip()) and not s.startswith("#")]
        if kept:
            text = " ".join(kept)
            if len(text.encode()) <= SUMMARY_BYTES:
                return text
            head = text.encode()[:SUMMARY_BYTES].decode(errors="ignore")
            whole = head if len(head.encode()) == SUMMARY_BYTES else head + text[len(head)]
            return whole + "..."
    return None


def parse(content: str) -> tuple:
    """A row of FRONTMATTER."""
    start = _OPEN.match(content)
    end = _CLOSE.search(content, start.end()) if start else None
    if not end:
        return None, [], [], None, None, 0, content, 0
    got = _fields(content[start.end() : end.start()])
    body = content[end.end() :]
    summary = got.get("summary") or first_paragraph(body)
    head = content[: end.end()]
    offset = len(head.encode())
    return got.get("title"), got.get("tags", []), got.get("aliases", []), summary, got.get("type"), offset, body, head.count("\n")


@F.pandas_udf(FRONTMATTER)
def frontmatter(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for series in contents:
        yield pd.DataFrame([parse(c or "") for c in series], columns=FRONTMATTER.names)
