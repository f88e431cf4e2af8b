"""Token-id files with a minimal perfect hash index (operator 10).

A shard holds the documents of one range of doc_id.  ``<shard>.ids`` is raw
little-endian ids, documents one after the other, behind a magic number.
``<shard>.idx`` is its index, of fixed layout: a header, the levels and blocks of
a minimal perfect hash over the keys, a row for each of the hash's slots (the
key's fingerprint, its first record and how many it has), and the offset of each
record.  A lookup goes key, slot, record, offset; it reads the header, a block a
level, one slot and two offsets, however many keys there are.  The fingerprint
is a reversible hash of the whole key, so a key that isn't there is never found.

Tasks write through the file system that the folder's URI names, under a name of
their own attempt.  ``MANIFEST.json`` is written last and names the attempts that
finished, so a lost or repeated task leaves at most a file that nothing names,
and a folder without a manifest holds nothing yet.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_by_bytes, scratch_path, small_batches, texts_of
from .perfect_hash import BLOCK, LEVEL, PerfectHash, Rows, mix, unmixed
from .word_pieces import id_encoder, id_type, tokenizer_path

MAGIC, INDEX_MAGIC = b"QNLIDS01", b"QNLIDX02"
#: records, records without a key, keys, keys in levels, levels, blocks, keys beyond the levels.
HEADER = struct.Struct("<8s7q")
SLOT = np.dtype([("print", "<u8"), ("first", "<i8"), ("count", "<i8")])
OFFSET = np.dtype("<i8")
PRINT_SEED = 0xF1
MANIFEST = "MANIFEST.json"
#: Bytes of input of a shard: as many as a task holds keys and offsets for without trouble; fewer where that leaves cores idle.
SHARD_BYTES, LEAST_SHARD_BYTES = 256 << 20, 4 << 20
BATCH_BYTES = 1 << 20
READ_BYTES = 8 << 20


class Index:
    """The index of one shard; ``file`` is anything that seeks and reads."""

    def __init__(self, file):
        self.file = file
        file.seek(0)
        magic, self.n, self.nameless, keys, placed, levels, blocks, rest = HEADER.unpack(file.read(HEADER.size))
        if magic != INDEX_MAGIC:
            raise ValueError("not an index of token ids")
        at, parts = HEADER.size, []
        for dtype, count in ((LEVEL, levels), (BLOCK, blocks), (OFFSET, rest), (SLOT, keys), (OFFSET, self.n + 1)):
            parts.append(Rows(file, at, dtype, count))
            at += dtype.itemsize * count
        self.rows, self.slots, self.offsets = parts, parts[3], parts[4]
        self.hash = PerfectHash(parts[0].load().held, parts[1], parts[2], placed)

    @staticmethod
    def pack(keys: list, lengths: list[int]) -> bytes:
        """keys: doc_ids in ascending order, None first; equal ones stand together."""
        nameless = next((i for i, k in enumerate(keys) if k is not None), len(keys))
        own, first, count = np.unique(np.array(keys[nameless:], np.int64), return_index=True, return_counts=True)
        perfect = PerfectHash.build(own)
        slots = np.zeros(len(own), SLOT)
        at = perfect.slots(own)
        slots["print"][at], slots["first"][at], slots["count"][at] = mix(own, PRINT_SEED), first + nameless, count
        blocks, rest = perfect.blocks.held, perfect.rest.held
        head = HEADER.pack(INDEX_MAGIC, len(keys), nameless, len(own), perfect.placed, len(perfect.levels), len(blocks), len(rest))
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(OFFSET)
        return b"".join([head, *(x.tobytes() for x in (perfect.levels, blocks, rest.astype(OFFSET), slots, offsets))])

    def load(self) -> Index:
        """Reads all of it, for many lookups."""
        for rows in self.rows:
            rows.load()
        return self

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first record of each key and how many it has; 0 and 0 for keys that aren't there."""
        keys = np.asarray(keys, np.int64)
        if not len(self.slots):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = self.hash.slots(keys)
        inside = (slot >= 0) & (slot < len(self.slots))
        row = self.slots[np.where(inside, slot, 0)]
        fits = inside & (row["print"] == mix(keys, PRINT_SEED))
        return np.where(fits, row["first"], 0), np.where(fits, row["count"], 0)

    def spans(self, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each record begin and end."""
        return self.offsets[records], self.offsets[records + 1]

    def keys(self) -> np.ndarray:
        """All keys, ascending, from their fingerprints."""
        return np.sort(unmixed(self.slots.load().held["print"], PRINT_SEED))


ROWS = "shard int, path string, low long, high long, nameless long, n_docs long, n_ids long"
ROW_TYPES = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
ROW_NAMES = [x.split()[0] for x in ROWS.split(", ")]


def shards_for(docs: DataFrame) -> int:
    """By the size that the plan states for the input; where it states none, the session's number of partitions."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if size >= 1 << 60:
        return wanted
    return max(1, min(wanted, -(-size // LEAST_SHARD_BYTES)), -(-size // SHARD_BYTES))


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int | None = 2, shards: int | None = None) -> TokenFiles:
    """Encodes every text, ids in ascending doc_id order, into files under ``path``.

    Rows of one doc_id stand together, by a hash of the text, in several shards
    if there are many.  Rows without a doc_id come first and can't be looked up
    by key; records of them are counted.  A null or empty text gives the end id
    alone; other columns are ignored; an empty table gives a manifest without
    shards.  A folder with a manifest is left as it is, with an error.
    """
    spark = docs.sparkSession
    small_batches(spark)
    fs, root = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{path} has token files already")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        encoder, keys, lengths, name, stream, fs = None, [], array("q"), "", None, None
        for ids, texts in rows_by_bytes(batches, BATCH_BYTES):
            if encoder is None:
                encoder = id_encoder(tokenizer_path(tokenizer))
                dtype = id_type(encoder.tokenizer)
                end = b"" if end_id is None else np.array([end_id], dtype).tobytes()
                fs, root = pafs.FileSystem.from_uri(path)
                fs.create_dir(root, recursive=True)
                name = f"shard-{shard:06d}-{attempt}"
                stream = fs.open_output_stream(f"{root}/{name}.ids")
                stream.write(MAGIC)
            for text in texts:
                size = 0
                for part in encoder.pieces(text):
                    size += stream.write(data := b"".join(encoder.values(part))) or len(data)
                stream.write(end)
                lengths.append((size + len(end)) // dtype.itemsize)
            keys += ids
        if encoder is None:
            return
        stream.close()
        with fs.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(Index.pack(keys, lengths))
        own = [k for k in keys if k is not None]
        row = [shard, name, own[0] if own else None, own[-1] if own else None, len(keys) - len(own), len(keys), sum(lengths)]
        yield pa.record_batch([pa.array([v], t) for v, t in zip(row, ROW_TYPES)], ROW_NAMES)

    texts = texts_of(docs).withColumn("h", F.xxhash64("text"))
    ordered = texts.repartitionByRange(shards or shards_for(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    rows = sorted((r.asDict() for r in ordered.mapInArrow(write, ROWS).collect()), key=lambda r: r["shard"])  # a row a shard
    start = 0
    for row in rows:
        row["start"], start = start, start + row["n_ids"]
    dtype = id_type(id_encoder(tokenizer_path(tokenizer)).tokenizer).str
    manifest = {"format": MAGIC.decode(), "dtype": dtype, "tokenizer": tokenizer, "end_id": end_id, "n_ids": start, "shards": rows}
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{MANIFEST}.new") as f:
        f.write(json.dumps(manifest).encode())
    fs.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")
    return TokenFiles(path, manifest)


class TokenFiles:
    """The files of a folder, by their manifest."""

    def __init__(self, path: str, manifest: dict):
        self.path, self.shards, self.dtype, self.n_ids = path, manifest["shards"], np.dtype(manifest["dtype"]), manifest["n_ids"]
        named = [s for s in self.shards if s["low"] is not None]  # ascending, and shards meet at most at an end
        self.named, self.highs = named, np.array([s["high"] for s in named], np.int64)
        self.lows = np.array([s["low"] for s in named], np.int64)

    @classmethod
    def open(cls, path: str) -> TokenFiles:
        """What a finished write left under ``path``, in this process or another."""
        fs, root = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
            return cls(path, json.loads(f.read()))

    def file(self, shard: dict, kind: str):
        fs, root = pafs.FileSystem.from_uri(self.path)
        return fs.open_input_file(f"{root}/{shard['path']}.{kind}")

    def holding(self, low: int, high: int) -> list[dict]:
        """The shards that may hold keys from ``low`` to ``high``."""
        return self.named[np.searchsorted(self.highs, low) : np.searchsorted(self.lows, high, "right")]

    def ids(self, doc_id: int) -> list[list[int]]:
        """The ids of each record of ``doc_id``: by seeks, one lookup a shard that may hold it."""
        out = []
        for shard in self.holding(doc_id, doc_id):
            with self.file(shard, "idx") as index_file, self.file(shard, "ids") as f:
                index = Index(index_file)
                first, count = (int(x[0]) for x in index.find(np.array([doc_id])))
                for record in range(first, first + count):
                    a, b = (int(x[0]) * self.dtype.itemsize for x in index.spans(np.array([record])))
                    f.seek(len(MAGIC) + a)
                    out.append(np.frombuffer(f.read(b - a), self.dtype).tolist())
        return out


SUMS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _sums(files: TokenFiles, shard: dict, index: Index, keys: list, records: np.ndarray) -> Iterator[pa.RecordBatch]:
    """doc_id, start, n_tokens, ids_crc32 of some records, ascending, read a few megabytes at a time."""
    begin, end = index.spans(records)
    width = files.dtype.itemsize
    with files.file(shard, "ids") as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{shard['path']} isn't a token-id file")
        at = 0
        while at < len(records):
            to = max(at + 1, int(np.searchsorted(end, begin[at] + READ_BYTES // width, "right")))
            low, high = int(begin[at]), int(end[to - 1])
            f.seek(len(MAGIC) + low * width)
            wide = memoryview(np.frombuffer(f.read((high - low) * width), files.dtype).astype("<u4").tobytes())
            crcs = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip((begin[at:to] - low).tolist(), (end[at:to] - low).tolist())]
            columns = [pa.array(keys[at:to], pa.int64()), pa.array(begin[at:to] + shard["start"]), pa.array(end[at:to] - begin[at:to]), pa.array(crcs, pa.int64())]
            yield pa.record_batch(columns, [x.split()[0] for x in SUMS.split(", ")])
            at = to


def _looked_up(files: TokenFiles, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sums of all records of ascending distinct keys, each found through its shards' hashes; an error if one isn't."""
    seen = np.zeros(len(keys), bool)
    for shard in files.holding(int(keys[0]), int(keys[-1])) if len(keys) else ():
        with files.file(shard, "idx") as f:
            index = Index(f).load()
        here = slice(np.searchsorted(keys, shard["low"]), np.searchsorted(keys, shard["high"], "right"))
        first, count = index.find(keys[here])
        seen[here] |= count > 0
        records = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        yield from _sums(files, shard, index, np.repeat(keys[here], count).tolist(), records)
    if not seen.all():
        raise KeyError(f"no record of doc_id {keys[~seen][0]}")


def look_up(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record of the keys in the column doc_id, by keyed access.

    Repeated keys count once; a null key stands for the records without one; a
    key that the files don't hold is an error.
    """
    spark = keys.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(files)  # a row a shard

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column("doc_id") for b in batches if b.num_rows]
        if not held:
            return
        column = pa.chunked_array(held)
        if column.null_count:
            for shard in shared.value.shards:
                if shard["nameless"]:
                    with shared.value.file(shard, "idx") as f:
                        index = Index(f).load()
                    yield from _sums(shared.value, shard, index, [None] * shard["nameless"], np.arange(shard["nameless"]))
        yield from _looked_up(shared.value, np.unique(column.drop_null().to_numpy().astype(np.int64)))

    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    # ranges of keys, so that a task opens few shards
    return wanted.repartitionByRange(max(1, len(files.shards)), "doc_id").mapInArrow(read, SUMS)


def scan(spark, files: TokenFiles) -> DataFrame:
    """The sums of every record, without a table of keys: each shard's keys come from its fingerprints."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(files)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n in (n for b in batches for n in b.column("id").to_pylist()):
            shard = shared.value.shards[n]
            with shared.value.file(shard, "idx") as f:
                index = Index(f).load()
            yield from _sums(shared.value, shard, index, [None] * index.nameless, np.arange(index.nameless))
            keys = index.keys()
            first, count = index.find(keys)
            records = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            yield from _sums(shared.value, shard, index, np.repeat(keys, count).tolist(), records)

    return spark.range(0, len(files.shards), 1, max(1, len(files.shards))).mapInArrow(read, SUMS)


def token_files(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the files of ``docs`` under ``path`` (the shared folder if None), and looks every document up in them.

    See write_token_files for nulls, empty texts and repeated rows; an empty
    table gives no row.
    """
    path = path or scratch_path(docs.sparkSession, "token-ids")
    write_token_files(docs, path, **options)
    return look_up(TokenFiles.open(path), docs)
