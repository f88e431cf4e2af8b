"""Line dedup (operator 3): sharded cuckoo filters over exact reference counts.

The state has three tables: ``lines`` (a document's distinct line keys),
``counts`` (for each key the exact number of documents that hold it and the
largest of them) and ``filters`` (for each shard of keys a cuckoo filter of those
in enough documents to lose their lines).  Inserting documents adds to the
counts and puts keys that become frequent into the filters; deleting documents
takes their references back, and takes keys that no longer are frequent out
again, which a cuckoo filter allows.  So an insertion that is deleted again
leaves what was there before.

Lines of documents are sent to the filters of their shard, not the filters to
the driver.  What passes is joined with the exact counts, so that a filter's
false positives never drop a line.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .common import columns_of, map_rows, rows_by_bytes, small_batches, stored, texts_of

LEAST_CHARS, LEAST_DOCS = 40, 5
STRIP = b" \t\n\x0b\x0c\r"
#: Frequent keys that a shard's filter is meant for, and lines that a probing task group holds.
SHARD_KEYS, GROUP_LINES = 100_000, 100_000
SLOTS, ROUNDS = 4, 300
BATCH_BYTES = 2 << 20


def key_of(line: bytes) -> bytes:
    """The key of a line: stripped of ASCII white space, A-Z lower-cased (as bytes.lower() does)."""
    return line.strip(STRIP).lower()


def counts_as_long(key: bytes, least: int = LEAST_CHARS) -> bool:
    if len(key) < least:
        return False
    return len(key) >= 4 * least or key.isascii() or len(key.decode()) >= least


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints, four to a bucket; further tables follow when one is full."""

    def __init__(self, tables: list[np.ndarray] | None = None):
        self.tables = tables or []

    @classmethod
    def load(cls, data: bytes | None) -> Cuckoo:
        if not data:
            return cls()
        with np.load(io.BytesIO(data)) as z:
            return cls([z[f"t{i}"] for i in range(len(z.files))])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f"t{i}": t for i, t in enumerate(self.tables)})
        return out.getvalue()

    @staticmethod
    def _place(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints (never 0) and both buckets of 64-bit keys."""
        k = keys.view(np.uint64)
        prints = ((k >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = (k & np.uint64(buckets - 1)).astype(np.int64)
        return prints, one, Cuckoo._other(one, prints, buckets)

    @staticmethod
    def _other(bucket: np.ndarray, prints: np.ndarray, buckets: int) -> np.ndarray:
        return bucket ^ (prints.astype(np.int64) * 0x5BD1E995 & (buckets - 1))

    @staticmethod
    def _settle(table: np.ndarray, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots of their buckets; which ones found none."""
        order = np.argsort(at, kind="stable")
        b = at[order]
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
        rank = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
        free = table[b] == 0
        placed = rank < free.sum(axis=1)
        slot = np.argmax((np.cumsum(free, axis=1) == rank[:, None] + 1) & free, axis=1)
        table[b[placed], slot[placed]] = prints[order][placed]
        left = np.ones(len(at), bool)
        left[order[placed]] = False
        return left

    def insert(self, keys: np.ndarray) -> None:
        """Adds distinct keys that aren't there."""
        keys = np.asarray(keys, np.int64)
        while len(keys):
            if not self.tables:
                self.tables.append(np.zeros((_buckets(len(keys)), SLOTS), np.uint16))
            keys = self._into(self.tables[-1], keys)
            if len(keys):
                self.tables.append(np.zeros((max(2 * len(self.tables[-1]), _buckets(len(keys))), SLOTS), np.uint16))

    @classmethod
    def _into(cls, table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Fills a table as far as it goes; the keys that are left.  A full table is put back as it was."""
        room = int(0.9 * table.size) - int((table != 0).sum())
        keys, rest = keys[: max(0, room)], keys[max(0, room) :]
        before = table.copy()
        prints, at, other = cls._place(keys, len(table))
        left = cls._settle(table, prints, at)
        prints, at = prints[left], other[left]
        rng = np.random.default_rng(len(table))
        for _ in range(ROUNDS):
            left = cls._settle(table, prints, at)
            prints, at = prints[left], at[left]
            if not len(prints):
                return rest
            # one fingerprint a bucket takes another's slot, which moves to its other bucket
            _, one = np.unique(at, return_index=True)
            slot = rng.integers(0, SLOTS, len(one))
            out = table[at[one], slot].copy()
            table[at[one], slot] = prints[one]
            moved = cls._other(at[one], out, len(table))
            prints[one], at[one] = out, moved
        table[:] = before
        return np.concatenate([keys, rest])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.int64)
        hit = np.zeros(len(keys), bool)
        for table in self.tables:
            prints, one, two = self._place(keys, len(table))
            hit |= (table[one] == prints[:, None]).any(axis=1) | (table[two] == prints[:, None]).any(axis=1)
        return hit

    def delete(self, keys: np.ndarray) -> None:
        """Removes keys that are there."""
        for key in np.asarray(keys, np.int64):
            for table in reversed(self.tables):
                prints, one, two = self._place(np.array([key]), len(table))
                for bucket in (one[0], two[0]):
                    if len(at := np.flatnonzero(table[bucket] == prints[0])):
                        table[bucket, at[0]] = 0
                        break
                else:
                    continue
                break


def _buckets(keys: int) -> int:
    return 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (0.85 * SLOTS)))))


def line_keys(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """a, b, doc_id: 128-bit hashes of each document's distinct keys of at least ``least`` code points."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_by_bytes(batches, BATCH_BYTES):
            digests, owners = [], []
            for doc_id, text in zip(ids, texts):
                keys = {k for line in text.encode().split(b"\n") if counts_as_long(k := key_of(line), least)}
                digests += map(xxhash.xxh3_128_digest, keys)
                owners += [doc_id] * len(keys)
            pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(owners, pa.int64())], ["a", "b", "doc_id"])

    known = texts_of(docs).where("doc_id IS NOT NULL AND length(text) > 0")
    return known.mapInArrow(run, "a long, b long, doc_id long")


COUNTS = "a long, b long, n_docs long, last_doc long"
FILTERS = "shard int, filter binary"


class LineDedup:
    """The state; insert, delete and clean return or change it as a whole, table by table."""

    def __init__(self, spark: SparkSession, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, shards: int | None = None):
        self.spark, self.least_chars, self.least_docs, self.shards = spark, least_chars, least_docs, shards
        self.lines = spark.createDataFrame([], "a long, b long, doc_id long")
        self.counts = spark.createDataFrame([], COUNTS)
        self.filters = spark.createDataFrame([], FILTERS)

    def _count(self, lines: DataFrame) -> DataFrame:
        # by key and document first, so that a line of a third of all documents is spread out
        pairs = lines.groupBy("a", "b", "doc_id").agg(F.lit(1).alias("one"))
        return pairs.groupBy("a", "b").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))

    def insert(self, docs: DataFrame) -> LineDedup:
        """Adds documents; one of a doc_id that is there already takes the old one's place."""
        if self.shards is not None:
            ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
            again = stored(self.lines.select("doc_id").distinct().join(ids, "doc_id", "left_semi"), "again")
            if not again.isEmpty():
                self.delete(again)
        new = stored(line_keys(docs, self.least_chars), "lines")
        added = self._count(new)
        first = self.shards is None
        both = self.counts.unionByName(added).groupBy("a", "b")
        counts = added if first else both.agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        counts = stored(counts, "counts")
        self._refilter(counts)
        self.lines = new if first else self.lines.unionByName(new)
        self.counts = counts
        return self

    def delete(self, doc_ids: DataFrame) -> LineDedup:
        """Takes documents out again; doc_ids has a column doc_id."""
        ids = doc_ids.select("doc_id").distinct()
        gone = self.lines.join(ids, "doc_id", "left_semi")
        left = stored(self.lines.join(ids, "doc_id", "left_anti").select("a", "b", "doc_id"), "lines")
        touched = gone.select("a", "b").distinct()
        same = self.counts.join(touched, ["a", "b"], "left_anti")
        changed = self._count(left.join(touched, ["a", "b"], "left_semi"))
        counts = stored(same.unionByName(changed), "counts")
        self._refilter(counts)
        self.lines, self.counts = left, counts
        return self

    def _frequent(self, counts: DataFrame) -> DataFrame:
        return counts.where(F.col("n_docs") >= self.least_docs)

    def _refilter(self, counts: DataFrame) -> None:
        """Brings the filters from the present counts to ``counts``: keys that become frequent go in, others come out."""
        old, new = self._frequent(self.counts).select("a", "b"), self._frequent(counts).select("a", "b")
        n = new.count()
        if self.shards is None or n > 2 * SHARD_KEYS * self.shards:
            # the filters are made anew, for as many shards as the keys need
            self.shards = max(self.shards or 1, -(-n // SHARD_KEYS))
            self.filters = self.spark.createDataFrame([], FILTERS)
            change = new.withColumn("put", F.lit(True))
        else:
            into, out = new.join(old, ["a", "b"], "left_anti"), old.join(new, ["a", "b"], "left_anti")
            change = into.withColumn("put", F.lit(True)).unionByName(out.withColumn("put", F.lit(False)))
        change = change.withColumn("shard", self._shard())

        def update(key: tuple, filters: pa.Table, changes: pa.Table) -> pa.Table:
            cuckoo = Cuckoo.load(filters.column("filter")[0].as_py() if filters.num_rows else None)
            changes = changes.sort_by([("b", "ascending"), ("a", "ascending")])
            keys, put = changes.column("b").to_numpy(), changes.column("put").to_numpy()
            cuckoo.delete(keys[~put])
            cuckoo.insert(keys[put])
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([cuckoo.dump()], pa.binary())})

        both = self.filters.groupBy("shard").cogroup(change.groupBy("shard"))
        self.filters = stored(both.applyInArrow(update, FILTERS), "filters")

    def _shard(self):
        return F.pmod(F.col("a"), F.lit(self.shards)).cast("int")

    def passing(self, lines: DataFrame) -> DataFrame:
        """The rows of a, b, doc_id whose key its shard's filter may hold."""
        groups = max(2 * int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // GROUP_LINES))
        salts = max(1, -(-groups // (self.shards or 1)))
        dealt = lines.withColumn("shard", self._shard()).withColumn("salt", F.pmod(F.xxhash64("doc_id", "b"), F.lit(salts)).cast("int"))
        copies = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

        def probe(filters: pa.Table, part: pa.Table) -> pa.Table:
            part = part.select(["a", "b", "doc_id"])
            if not filters.num_rows:
                return part.slice(0, 0)
            cuckoo = Cuckoo.load(filters.column("filter")[0].as_py())
            return part.filter(pa.array(cuckoo.contains(part.column("b").to_numpy())))

        both = copies.groupBy("shard", "salt").cogroup(dealt.groupBy("shard", "salt"))
        return both.applyInArrow(probe, "a long, b long, doc_id long")

    def drops(self, lines: DataFrame) -> DataFrame:
        """doc_id, keys: what each document loses, as hashes; documents that lose nothing have no row."""
        frequent = self._frequent(self.counts).select("a", "b", "last_doc")
        lost = self.passing(lines).join(frequent, ["a", "b"]).where("doc_id < last_doc")
        return lost.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("keys"))

    def clean(self, docs: DataFrame, lines: DataFrame | None = None, counted: bool = True, counted_chars: str | None = None) -> DataFrame:
        """All columns of ``docs`` with text cleaned, plus n_lines and n_dropped if ``counted``; lines: line_keys(docs) if at hand.

        Keys found in ``least_docs`` documents or more lose their lines except in
        the largest doc_id that holds them.  A null or empty text is one empty
        line; a null text becomes empty.  Rows without a doc_id aren't counted
        and keep all their lines; rows of one doc_id count as one document.
        Columns of ``docs`` that are named n_lines or n_dropped give way to the
        counts.  counted_chars: a column of docs that holds a text's number of
        characters, brought up to date where lines go.
        """
        lines = line_keys(docs, self.least_chars) if lines is None else lines
        taken = {c.lower() for c in docs.columns}
        own = next(n for i in range(len(taken) + 1) if (n := f"keys_{i}") not in taken)
        lost = self.drops(lines).select(F.col("doc_id"), F.col("keys").alias(own))
        joined = docs.join(lost, "doc_id", "left").select(*columns_of(docs), own)
        return self._rewritten(joined, docs, own, ("n_lines", "n_dropped") if counted else (), counted_chars)

    def _rewritten(self, joined: DataFrame, docs: DataFrame, own: str, counts: tuple, chars: str | None) -> DataFrame:
        small_batches(self.spark)
        least, fields = self.least_chars, [f for f in docs.schema if f.name.lower() not in counts]
        columns = [f.name for f in fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, n_lines, n_dropped = [], [], []
                for text, keys in zip(batch.column("text").to_pylist(), batch.column(own).to_pylist()):
                    parts = (text or "").encode().split(b"\n")
                    kept = parts
                    if keys:
                        lost = {(k["a"], k["b"]) for k in keys}
                        kept = [p for p in parts if not (counts_as_long(k := key_of(p), least) and _hash(k) in lost)]
                    n_lines.append(len(parts))
                    n_dropped.append(len(parts) - len(kept))
                    texts.append(text or "" if len(kept) == len(parts) else b"\n".join(kept).decode())
                made = {"text": pa.array(texts, pa.string())}
                if chars:
                    held = batch.column(chars)
                    made[chars] = pa.array([len(t) if d else n for t, d, n in zip(texts, n_dropped, held.to_pylist())], held.type)
                out = [made[n] if n in made else batch.column(n) for n in columns]
                yield pa.record_batch([*out, *(pa.array(x, pa.int64()) for x in (n_lines, n_dropped)[: len(counts)])], [*columns, *counts])

        return map_rows(joined, run, fields + [StructField(n, LongType()) for n in counts])


def _hash(key: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(key)
    return tuple(int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))


def dedup_lines(docs: DataFrame, counted: bool = True, counted_chars: str | None = None, **options) -> DataFrame:
    """LineDedup(...).insert(docs).clean(docs), with the lines read once."""
    state = LineDedup(docs.sparkSession, **options).insert(docs)
    return state.clean(docs, state.lines, counted, counted_chars)


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of ``docs``."""
    cleaned = dedup_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, part.i AS i, part.line AS line,
         translate(trim(part.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'i': i, 'line': x})) AS part FROM documents)
), frequent AS (
  SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE f.key IS NOT NULL AND l.doc_id <> f.last_doc) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE f.key IS NULL OR l.doc_id = f.last_doc), '')) AS kept_sha256
FROM lines l LEFT JOIN frequent f ON l.key = f.key
GROUP BY l.doc_id
"""
