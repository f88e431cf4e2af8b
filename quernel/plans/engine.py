"""The engine: search and upkeep over one note folder."""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Config, load
from ..functions.embed import Embedder, HttpEmbedder, health, name_of
from ..functions.text import csv_tags, has_all
from ..operators import fulltext, graph, hybrid, vectors
from ..operators.context import context_window
from ..sources import notes as folder
from ..sources import render
from .index import Stats, Store, refresh

MODES = ("hybrid", "semantic", "fts")


@dataclass
class Response:
    results: DataFrame
    linked_notes: DataFrame

    def to_json(self) -> str:
        return render.to_json(self.results, self.linked_notes)


class Engine:
    """Search and upkeep over a note folder; vectors come from the configuration's endpoint if no embedder is given."""

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, embedder: Embedder | None = None, store: str | None = None):
        self.spark, self.root, self.config = spark, root, config or load(root)
        self.embedder = embedder or HttpEmbedder(self.config.embedding)
        self.store = Store(spark, store or self.config.index_path())
        if store is None and not self.store.version():
            self.store.migrate(os.path.join(root, self.config.index.data_dir))

    def scan(self) -> DataFrame:
        """The notes as they are now: path, modified, content."""
        return folder.scan_notes(self.spark, self.root)

    def refresh(self, force: bool = False, **options) -> Stats:
        return refresh(self.store, self.scan(), self.config, self.embedder, force, **options)

    def query_vector(self, text: str) -> list[float] | None:
        """None where the embedder fails, which leaves full-text search."""
        try:
            return self.embedder.embed([text])[0]
        except Exception:  # noqa: BLE001
            return None

    def semantic(self, text: str, limit: int, folders: list[str] | None = None, tags: list[str] | None = None, prefilter: bool = False, head: dict | None = None) -> DataFrame:
        """Vector hits; none where the embedder fails, or where the index holds another model's vectors."""
        head = head or self.store.head()
        if head["model"] not in (None, name_of(self.embedder)):
            warnings.warn(f"the index has vectors of {head['model']}, not of {name_of(self.embedder)}; refresh it", stacklevel=2)
            return self.spark.createDataFrame([], schemas.RESULTS)
        query = self.query_vector(text)
        if query is None:
            return self.spark.createDataFrame([], schemas.RESULTS)
        return vectors.semantic(self.store.table("vectors", head), query, limit, folders, tags, prefilter)

    def fts(self, text: str, limit: int | None, head: dict | None = None) -> DataFrame:
        head = head or self.store.head()
        hits = fulltext.search_index(self.store.table("postings", head), self.store.table("lengths", head), text, limit, buckets=head["buckets"])
        return hybrid.fts_results(hits)

    def search(
        self, text: str, limit: int | None = None, mode: str = "hybrid", folders: list[str] | None = None, tags: list[str] | None = None,
        exclude: list[str] | None = None, threshold: float | None = None, since: str | None = None, prefilter: bool = False, strict: bool = False,
    ) -> Response:
        """Results and linked notes, all of one version of the index.

        Folders and tags hold for vector hits only; with ``strict`` for full-text
        hits too.  Exclude, threshold and since look at the final results and
        not at linked notes.
        """
        if mode not in MODES:
            raise ValueError(f"mode {mode} isn't one of {', '.join(MODES)}")
        limit = self.config.search.default_limit if limit is None else limit
        head = self.store.head()
        linked = self.spark.createDataFrame([], schemas.LINKED)
        if mode == "semantic":
            results = self.semantic(text, limit, folders, tags, prefilter, head)
        else:
            narrowed = strict and (folders is not None or tags is not None)
            found = self.fts(text, limit if mode == "fts" else 2 * limit, head)
            if narrowed:
                found = self._within(found, folders, tags, head)
            if mode == "fts":
                results = found
            else:
                results = hybrid.merge(self.semantic(text, 2 * limit, folders, tags, prefilter, head), found, limit, self.config.search)
                # a few rows, used by every later step
                results = self.spark.createDataFrame(results.collect(), schemas.RESULTS)
                linked = graph.linked_notes(graph.ranked(results), self.store.table("links", head))
        if exclude:
            results = hybrid.exclude(results, exclude)
        if threshold is not None:
            results = hybrid.threshold(results, threshold)
        if since:
            results = hybrid.since(results, self.store.table("notes", head), since)
        return Response(results, linked)

    def _within(self, found: DataFrame, folders: list[str] | None, tags: list[str] | None, head: dict) -> DataFrame:
        """Full-text hits in the folders whose notes have the tags."""
        if folders is not None:
            found = found.where(hybrid.starts_with_any(F.col("path"), folders))
        if tags is not None:
            tagged = self.store.table("notes", head).where(has_all(csv_tags(F.col("tags")), tags)).select("path")
            found = found.join(tagged, "path", "left_semi").select(found.columns)
        return found

    def context(self, results: DataFrame, around: int) -> DataFrame:
        """The lines around each hit, in the whole note's numbering."""
        offset = self.store.table("vectors").select("path", "body_line_offset").distinct()
        hits = results.where("start_line > 0").join(offset, "path")
        whole = hits.select("path", "start_line", (F.col("start_line") + F.col("body_line_offset")).alias("a"), (F.col("end_line") + F.col("body_line_offset")).alias("b"))
        lines = context_window(whole.select("path", F.col("a").alias("start_line"), F.col("b").alias("end_line")), self.store.table("notes"), around)
        back = whole.select("path", "start_line", "a").distinct()
        return lines.withColumnRenamed("start_line", "a").join(back, ["path", "a"]).select("path", "start_line", "line_no", "line", "is_match")

    def get(self, path: str) -> str:
        return folder.get_note(folder.scan_notes(self.spark, self.root), path)

    def list(self, path: str = "", recursive: bool = False) -> DataFrame:
        return folder.list_folder(self.spark, self.root, path, recursive)

    def register(self, prefix: str = "") -> None:
        """The index's tables as views, for SQL."""
        head = self.store.head()
        for name in ("notes", "vectors", "postings", "lengths", "links", "manifest"):
            self.store.table(name, head).createOrReplaceTempView(prefix + name)

    def status(self) -> dict:
        e = self.config.embedding
        state, message = health(e)
        found = graph.stats(self.store.table("links")).first()
        return {
            "provider": e.provider, "endpoint": e.endpoint, "model": e.model, "api_key": "set" if e.api_key else "not set", "health": state.value, "message": message,
            "root": self.root, "snapshot": self.store.version(), "graph_nodes": found.node_count, "graph_edges": found.edge_count,
        }

    def call(self, command: str, **arguments) -> str:
        """The tool surface: search, index, get, list, status, as text."""
        if command == "search":
            query, mode = arguments.pop("query", ""), arguments.get("mode", "hybrid")
            if not query.strip():
                return "Error: query is empty"
            if mode not in MODES:
                return f"Unknown mode: {mode}"
            response = self.search(query, **arguments)
            return render.to_json(response.results, response.linked_notes, always=False) if mode == "hybrid" else render.to_array(response.results)
        if command == "index":
            return str(self.refresh(arguments.get("force", False)))
        if command == "get":
            path = arguments.get("path", "")
            return self.get(path) if path else "Error: path is empty"
        if command == "list":
            return folder.listing(self.list(arguments.get("path", ""), arguments.get("recursive", False)))
        if command == "status":
            return "\n".join(f"{k}: {v}" for k, v in self.status().items())
        return f"Unknown command: {command}"
