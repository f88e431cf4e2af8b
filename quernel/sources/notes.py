"""Note folders as DataFrames: scan, get, list.

Names are walked on the driver; contents are read by executors, so the folder
must be one that they see.  A folder given as a URI is read by Spark's own
binary source instead, which leaves out files and folders whose names begin with
a dot or an underscore.
"""

from __future__ import annotations

import datetime
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import NOTES

# Folders that are never looked into.
EXCLUDED = (".obsidian", ".git", ".trash", "node_modules", ".smart-connections", ".vault-mcp")
#: Notes that a task reads.
FILES = 256
ENTRIES = "name string, is_dir boolean, path string"


def _walk(root: str) -> Iterator[os.DirEntry]:
    """All entries below a folder but excluded ones; what can't be read is skipped, links aren't followed."""
    try:
        entries = sorted(os.scandir(root), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        if e.name in EXCLUDED:
            continue
        yield e
        if e.is_dir(follow_symlinks=False):
            yield from _walk(e.path)


def _files(root: str) -> list[tuple]:
    if os.path.basename(os.path.normpath(root)) in EXCLUDED:
        return []
    out = []
    for e in _walk(root):
        if e.is_file(follow_symlinks=False) and os.path.splitext(e.name)[1] == ".md" and e.name != ".md":
            try:
                info = e.stat(follow_symlinks=False)
            except OSError:
                continue
            changed = datetime.datetime.fromtimestamp(int(info.st_mtime), datetime.UTC)
            out.append((os.path.relpath(e.path, root).replace(os.sep, "/"), e.path, changed, info.st_size))
    return out


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for path in batch.column("abs_path").to_pylist():
            try:
                with open(path, "rb") as f:
                    texts.append(f.read().decode("utf-8"))
            except (OSError, UnicodeDecodeError):
                texts.append("")  # such a note counts as empty
        yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "content"])


def scan_notes(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """path, abs_path, modified, length, content of every note below a folder."""
    if re.match(r"\w[\w+.-]+://", root):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
        path = F.substring_index("path", F.lit(root.split("://", 1)[1].strip("/") + "/"), -1)
        return notes_of(files.select(path.alias("path"), F.col("path").alias("abs_path"), F.col("modificationTime").alias("modified"), "length", F.decode("content", F.lit("UTF-8")).alias("content")))
    rows = _files(root)
    listed = spark.createDataFrame(rows, "path string, abs_path string, modified timestamp, length bigint")
    return listed.repartition(partitions or max(1, -(-len(rows) // FILES)), "path").mapInArrow(_contents, NOTES)


def notes_of(files: DataFrame) -> DataFrame:
    """The files (with a column path, below the folder) that are notes: .md files that no excluded folder holds."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return files.where(name.endswith(".md") & (name != ".md") & ~F.arrays_overlap(parts, F.lit(list(EXCLUDED))))


def find_note(notes: DataFrame, path: str) -> DataFrame:
    """path, content of the scanned note of that path; none for a path that leads out of the folder."""
    return notes.where(F.col("path") == path).select("path", "content")


def get_note(notes: DataFrame, path: str) -> str:
    """A note's text, looked up among the scanned ones, so that no path leads out of the folder."""
    row = find_note(notes, path).first()
    if row is None:
        raise FileNotFoundError(path)
    return row.content


def list_folder(spark: SparkSession, root: str, folder: str = "", recursive: bool = False) -> DataFrame:
    """name, is_dir, path of a folder's entries; none if there is no such folder."""
    base = os.path.normpath(os.path.join(root, folder))
    if os.path.commonpath([os.path.abspath(root), os.path.abspath(base)]) != os.path.abspath(root):
        return spark.createDataFrame([], ENTRIES)
    if recursive:
        entries = list(_walk(base))
    else:
        entries = [e for e in sorted(os.scandir(base), key=lambda e: e.name) if e.name not in EXCLUDED] if os.path.isdir(base) else []
    rows = [(e.name, e.is_dir(follow_symlinks=False), os.path.relpath(e.path, root).replace(os.sep, "/")) for e in entries]
    return spark.createDataFrame(rows, ENTRIES)


def folder_of(paths: DataFrame, folder: str = "", recursive: bool = False) -> DataFrame:
    """The same listing from paths of notes alone, folders being their prefixes."""
    base = folder.rstrip("/") + "/" if folder else ""
    rest = paths.where(F.col("path").startswith(base)).select(F.split(F.substr("path", F.lit(len(base) + 1)), "/").alias("parts"))
    depth = F.sequence(F.lit(1), F.size("parts")) if recursive else F.array(F.lit(1))
    each = rest.select("parts", F.explode(depth).alias("n"))
    name = F.element_at("parts", F.col("n"))
    path = F.concat(F.lit(base), F.array_join(F.slice("parts", 1, F.col("n")), "/"))
    return each.select(name.alias("name"), (F.col("n") < F.size("parts")).alias("is_dir"), path.alias("path")).distinct()


def listing(entries: DataFrame) -> str:
    rows = entries.orderBy("path").collect()
    return "\n".join([f"{len(rows)} entries:", *(f"{'[dir] ' if r.is_dir else '      '}{r.path}" for r in rows)])
