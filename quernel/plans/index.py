"""The index: versions of its tables, and their incremental upkeep.

A version adds rows to a table and names, in ``gone``, the notes whose earlier
rows no longer count; so a refresh writes what changed and no more.  After
SEGMENTS versions the next one holds whole tables again.  A version exists once
its file in ``commits`` does, which is written last and moved into place, so a
reader sees either the old index or the new one, and one that began before goes
on with its own.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Config
from ..functions.embed import Embedder, HashingEmbedder, embed_chunks, name_of
from ..functions.frontmatter import frontmatter
from ..functions.text import content_hash, note_title
from ..operators import fulltext, graph
from ..operators.chunks import chunk_notes
from ..operators.links import extract_links
from ..operators.vectors import dimension
from ..sources.legacy import json_manifest, json_vectors

LENGTHS = "path string, title string, dl_title int, dl_body int, dl_tags int"
TABLES = {
    "notes": "path string, title string, tags string, modified timestamp, content string",
    "manifest": schemas.MANIFEST,
    "vectors": schemas.VECTORS,
    "postings": schemas.POSTINGS,
    "lengths": LENGTHS,
    "links": schemas.LINKS,
}


#: The column that says whose rows they are, where it isn't path.
KEYS = {"links": "source_path"}
GONE = "kind string, path string"
#: Versions that are read together at most.
SEGMENTS = 8
#: Bytes of notes for each bucket of the full-text index, and the numbers of buckets that are used.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 64 << 20, 8, 4096


@dataclass
class Stats:
    total_files: int
    indexed: int
    skipped: int
    deleted: int
    total_chunks: int
    graph_nodes: int
    graph_edges: int


class Store:
    """Versions below a path of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("commits")):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(self._at("commits")))
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """The current version's number; 0 before the first."""
        return max(self.versions(), default=0)

    def head(self, version: int | None = None) -> dict:
        """version, base (the last one with whole tables), buckets, model of a version, the current one if None."""
        v = self.version() if version is None else version
        if not v:
            return {"version": 0, "base": 1, "buckets": LEAST_BUCKETS, "model": None}
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/commits/{v}").first()[0]
        return json.loads(text)

    def table(self, name: str, head: dict | None = None) -> DataFrame:
        """A table of a version: its rows since the base but those of notes that went or changed later."""
        head, schema, key = head or self.head(), TABLES[name], KEYS.get(name, "path")
        if not head["version"]:
            return self.spark.createDataFrame([], schema)
        numbers = range(head["base"], head["version"] + 1)
        at = lambda kind: [f"{self.path}/{kind}/v={n}" for n in numbers]
        if len(numbers) == 1:
            return self.spark.read.schema(schema).parquet(*at(name))
        rows = self.spark.read.schema(f"{schema}, v int").option("basePath", f"{self.path}/{name}").parquet(*at(name))
        gone = self.spark.read.schema(f"{GONE}, v int").option("basePath", f"{self.path}/gone").parquet(*at("gone")[1:])
        kind = "links" if name == "links" else "notes"
        last = gone.where(F.col("kind") == kind).groupBy(F.col("path").alias(key)).agg(F.max("v").alias("gone_v"))
        kept = rows.join(last, key, "left").where("gone_v IS NULL OR v >= gone_v")
        return kept.select(*(x.split()[0] for x in schema.split(", ")))

    def commit(self, tables: dict[str, DataFrame], gone: DataFrame | None = None, **head) -> int:
        """Adds a version of some rows, and of whole tables if ``gone`` is None; gone: kind, path."""
        v = self.version() + 1
        whole = gone is None
        tables = {n: self.spark.createDataFrame([], schema) for n, schema in TABLES.items()} | tables
        tables["gone"] = self.spark.createDataFrame([], GONE) if whole else gone
        for name, df in tables.items():
            if name == "postings":
                df = df.repartition("bucket").sortWithinPartitions("bucket", "term")
            writer = df.write.mode("overwrite")
            (writer.partitionBy("bucket") if name == "postings" else writer).parquet(f"{self.path}/{name}/v={v}")
        old = self.head(v - 1)
        made = {k: old[k] for k in ("base", "buckets", "model")} | head | {"version": v} | ({"base": v} if whole else {})
        new, final = self._at("commits", f"{uuid.uuid4().hex}.new"), self._at("commits", str(v))
        out = self._fs.create(new, False)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(new, final):
            self._fs.delete(new, False)
            raise RuntimeError(f"version {v} was committed by another writer")
        return v

    def drop_old(self, keep: int = 2) -> None:
        """Deletes versions but the last ``keep`` and what these need."""
        found = self.versions()
        if not found[:-keep]:
            return
        base = min(self.head(v)["base"] for v in found[-keep:])
        for v in found[:-keep]:
            self._fs.delete(self._at("commits", str(v)), False)
            if v < base:
                for name in (*TABLES, "gone"):
                    self._fs.delete(self._at(name, f"v={v}"), True)
        for name in (*TABLES, "gone"):  # of versions whose commit went in an earlier call
            for f in self._fs.listStatus(self._at(name)) if self._fs.exists(self._at(name)) else ():
                n = f.getPath().getName().removeprefix("v=")
                if n.isdigit() and int(n) < base:
                    self._fs.delete(f.getPath(), True)

    def has_documents(self) -> bool:
        return not self.table("lengths").isEmpty()

    def migrate(self, folder: str) -> bool:
        """Takes over vectors.json and hashes.json of an older index in ``folder``, if there is no version yet.

        Their notes count as known, so they aren't embedded again; full text and
        links follow with the next refresh.
        """
        at = lambda name: f"{folder.rstrip('/')}/{name}"
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path
        there = all(jvm(at(n)).getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm(at(n))) for n in ("vectors.json", "hashes.json"))
        if not there or self.version():
            return False
        self.commit({"vectors": json_vectors(self.spark, at("vectors.json")), "manifest": json_manifest(self.spark, at("hashes.json"))})
        return True


def classify(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """path, change (new, changed, unchanged or deleted), content_hash, by an outer join of two manifests."""
    old = manifest.select("path", F.col("content_hash").alias("old_hash"))
    change = (
        F.when(F.col("content_hash").isNull(), "deleted")
        .when(F.col("old_hash").isNull(), "new")
        .when(F.col("old_hash") != F.col("content_hash"), "changed")
        .otherwise("unchanged")
    )
    return old.join(current, "path", "full").select("path", change.alias("change"), F.coalesce("content_hash", "old_hash").alias("content_hash"))


def change_counts(changes: DataFrame) -> DataFrame:
    """total_files, indexed, skipped, deleted."""
    n = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    return changes.agg(
        n("new", "changed", "unchanged").alias("total_files"), n("new", "changed").alias("indexed"), n("unchanged").alias("skipped"), n("deleted").alias("deleted")
    )


def parsed(notes: DataFrame) -> DataFrame:
    """Notes with path and content: title, tags (comma-separated), body and body_line_offset besides."""
    read = notes.withColumn("fm", frontmatter("content"))
    return read.select(
        "path", note_title(F.col("fm.title"), F.col("path")).alias("title"), F.array_join("fm.tags", ",").alias("tags"),
        F.col("fm.body").alias("body"), F.col("fm.body_line_offset").alias("body_line_offset"), "content",
    )


def needs_rebuild(store: Store, embedder: Embedder) -> bool:
    """Whether stored vectors are of another model or length than the embedder's; anything that goes wrong means no."""
    try:
        model = store.head()["model"]
        if model is not None and model != name_of(embedder):
            return True
        held = dimension(store.table("vectors"))
        return held is not None and held != len(embedder.embed(["dimension"])[0])
    except Exception:  # noqa: BLE001
        return False


def _buckets(scanned: DataFrame) -> int:
    size = scanned.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    wanted = max(1, -(-size // BUCKET_BYTES))
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (wanted - 1).bit_length()))


def refresh(store: Store, scanned: DataFrame, config: Config, embedder: Embedder | None = None, force: bool = False, resolve_all: bool = True) -> Stats:
    """Brings the index up to date with ``scanned`` notes and returns what was done.

    Only new and changed notes are parsed, embedded and tokenised, and only
    their rows are written.  Links are resolved again for all notes, since a new
    note may be what an old link meant; ``resolve_all=False`` does so for
    changed notes only.  A failed embedding fails the refresh, and the old
    version stays.
    """
    embedder = embedder or HashingEmbedder()
    force = force or needs_rebuild(store, embedder)
    head = store.head()
    whole = force or not head["version"] or head["version"] - head["base"] + 1 >= SEGMENTS
    kept = []

    def held(df: DataFrame) -> DataFrame:
        kept.append(df.persist())
        return kept[-1]

    try:
        scanned = held(scanned)
        current = scanned.select("path", content_hash(F.col("content")).alias("content_hash"))
        old = {n: store.table(n, head).where("false") if force else store.table(n, head) for n in TABLES}
        changes = held(classify(old["manifest"], current))
        counts = change_counts(changes).first()
        work = changes.where("change IN ('new', 'changed')").select("path")
        stale = changes.where("change <> 'unchanged'").select("path")
        notes = held(parsed(scanned.join(work, "path", "left_semi")))
        chunks = held(chunk_notes(notes, config.index.max_chunk_tokens))
        # an index without full text, as a migrated one, gets that of all notes
        missing = not force and counts.skipped > 0 and not store.has_documents()
        texts = held(parsed(scanned)) if missing else notes
        buckets = _buckets(scanned) if whole else head["buckets"]
        docs, known = fulltext.documents(texts), scanned.select("path")
        if resolve_all or force or missing:
            links = extract_links(scanned.select("path", "content"), known)
        else:
            links = graph.update_links(old["links"], stale, extract_links(notes.select("path", "content"), known))
        links = held(links)
        dated = texts.join(scanned.select("path", "modified"), "path")
        fresh = {
            "notes": dated.select("path", "title", "tags", "modified", "content"),
            "vectors": embed_chunks(chunks, embedder),
            "postings": fulltext.postings(docs, buckets),
            "lengths": fulltext.lengths(docs),
            "manifest": changes.where("change IN ('new', 'changed')").select("path", "content_hash"),
        }
        if whole:
            gone = stale.distinct()
            for n, rows in fresh.items():
                left = old[n].join(gone, "path", "left_anti").select(rows.columns)
                if n == "postings":  # their number of buckets may be another one now
                    left = left.withColumn("bucket", fulltext.bucket(F.col("term"), buckets)).select(rows.columns)
                fresh[n] = left.unionByName(rows)
            store.commit(fresh | {"links": links}, buckets=buckets, model=name_of(embedder))
        else:
            before, now = old["links"].withColumn("side", F.lit(1)), links.withColumn("side", F.lit(-1))
            moved = before.unionByName(now).groupBy(*links.columns).agg(F.sum("side").alias("side")).where("side <> 0").select(F.col("source_path").alias("path")).distinct()
            moved = held(moved)
            fresh["links"] = links.join(moved.withColumnRenamed("path", "source_path"), "source_path", "left_semi").select(links.columns)
            gone = stale.select(F.lit("notes").alias("kind"), "path").unionByName(moved.select(F.lit("links").alias("kind"), "path"))
            store.commit(fresh, gone, model=name_of(embedder))
        store.drop_old()
        graph_stats = graph.stats(links).first()
        return Stats(counts.total_files, counts.indexed, counts.skipped, counts.deleted, chunks.count(), graph_stats.node_count, graph_stats.edge_count)
    finally:
        for df in kept:
            df.unpersist()
