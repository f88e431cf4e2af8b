"""Helpers that the corpus operators share: inputs, scratch tables, batching."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows and bytes of one Arrow batch: small, so that a Python worker's memory
#: doesn't depend on how long the texts are.
ARROW_ROWS, ARROW_BYTES = "1000", str(8 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes, unless the session already does."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES),
    ):
        try:
            default = spark.conf.get(key) in ("10000", str(2**31 - 1), "67108864b")
        except Exception:  # noqa: BLE001  the key is unknown to this version
            default = True
        if default:
            spark.conf.set(key, value)


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a new local one, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        root = "file://" + tempfile.mkdtemp(prefix="quernel-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/quernel/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "none") -> DataFrame:
    """``df`` written to the shared folder and reread: cuts lineage, survives lost executors.

    Hashes don't compress, and codecs hold native memory for every file; tables
    with texts ask for one.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    for scope in _SCOPES:
        scope.paths.append(path)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path  # type: ignore[attr-defined]  for drop_stored
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_stored(*frames: DataFrame) -> None:
    """Deletes scratch tables that no later step reads."""
    for df in frames:
        if path := getattr(df, "_scratch", None):
            _delete(df.sparkSession, path)


_SCOPES: list = []


class Scratch:
    """Deletes the scratch tables that were stored within, but those that are kept, once it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, *frames: DataFrame) -> None:
        kept = {getattr(df, "_scratch", None) for df in frames}
        self.paths = [p for p in self.paths if p not in kept]

    def __enter__(self) -> Scratch:
        _SCOPES.append(self)
        return self

    def __exit__(self, *_) -> None:
        _SCOPES.remove(self)
        for path in self.paths:
            _delete(self.spark, path)


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns_of(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]


def map_rows(df: DataFrame, run, fields: list[StructField] | None = None) -> DataFrame:
    """mapInArrow of ``run`` from Arrow batches to batches of ``fields`` (df's own if None), whatever the columns are named.

    Spark itself resolves names with dots or quotes otherwise, so the columns
    go by their numbers in between.
    """
    names, fields = df.columns, df.schema.fields if fields is None else fields
    numbered = [f"c{i}" for i in range(len(fields))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(b.rename_columns(names) for b in batches):
            yield out.rename_columns(numbered)

    schema = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(numbered, fields)])
    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(renamed, schema).toDF(*(f.name for f in fields))


#: Keys that are split at most; their list is broadcast.
HEAVY = 10_000


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, rows: int, counts: DataFrame | None = None, hint: str | None = None) -> DataFrame:
    """``left`` joined with ``right``, of one row a key; a key of more than ``rows`` rows of ``left`` is dealt into parts by ``by``.

    The HEAVY heaviest keys are split, so that of any other one a task gets less
    than a HEAVY-th of all rows.  counts: key and count, where they are at hand.
    ``left`` is read twice and should be a stored table.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("count")) if counts is None else counts
    heavy = counts.where(F.col("count") > rows).orderBy(F.desc("count"), key).limit(HEAVY).collect()
    hinted = lambda df: df.hint(hint) if hint else df
    if not heavy:
        return left.join(hinted(right), key)
    listed = [(r[key], -(-r["count"] // rows)) for r in heavy]
    parts = F.broadcast(left.sparkSession.createDataFrame(listed, f"{key} {left.schema[key].dataType.simpleString()}, parts_ long"))
    number = F.coalesce("parts_", F.lit(1))
    dealt = left.join(parts, key, "left").withColumn("part_", F.pmod(F.xxhash64(F.lit(29), by), number)).drop("parts_")
    copies = right.join(parts, key, "left").withColumn("part_", F.explode(F.sequence(F.lit(0).cast("long"), number - 1))).drop("parts_")
    return dealt.join(hinted(copies), [key, "part_"]).drop("part_")


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    """The session's number of shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts_of(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and text only; a null text reads as empty."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def rows_by_bytes(batches: Iterable[pa.RecordBatch], limit: int, text: str = "text") -> Iterator[tuple[list, list[str]]]:
    """Rows of Arrow batches, dealt anew into groups of about ``limit`` bytes of text."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).to_pylist()
        for i, t, size in zip(batch.column("doc_id").to_pylist(), batch.column(text).to_pylist(), sizes):
            size = size or 0
            if held and held + size > limit:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t or "")
            held += size
    if ids:
        yield ids, texts


_HELD: dict = {}


def held(key: tuple, make):
    """make(), kept by the worker process from task to task until another key is asked for.

    One thing at a time, so that a process that serves several operators in turn
    doesn't hold the memos of all of them.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


class Memo:
    """A bounded two-generation memo of ``make(list of keys) -> list of values``.

    When the young generation is full it becomes the old one and the old one
    goes, so frequent keys stay and memory has a fixed bound.
    """

    def __init__(self, make, capacity: int):
        self.make, self.capacity = make, capacity
        self.young: dict = {}
        self.old: dict = {}

    def fill(self, keys: set) -> None:
        """Afterwards ``young`` holds every one of ``keys``."""
        if len(self.young) + len(keys) > self.capacity and len(self.young) > self.capacity // 8:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        todo = []
        for k in keys:
            if (v := old.get(k)) is None:
                todo.append(k)
            else:
                young[k] = v
        if todo:
            young.update(zip(todo, self.make(todo)))
