"""MinHash near-dedup (operator 4): BagMinHash bands, then exact multiset overlap.

Exact copies meet first, by a hash of their words, and go on as one text.  Texts
that share a band are candidates.  They aren't paired with one another: a band's
texts are compared with one pivot of the band, whose choice differs from band to
band, and what is linked becomes one component.  Only bands that then still hold
several components are looked at again, with more pivots and at last with all,
and only across components.

A text's shingles that no other candidate holds bound the similarity it can
have: with s of its n shingles held by others, and u of the other text's own, it
is s / (n + u) at most.  So a band first loses, by aggregates alone, the texts
that can't reach the threshold with any text in it, and then no pairs are made
that can't, by a bound counted in PARTS classes of shingles.  Both are exact.

Texts go by the smallest doc_id of their exact copies, and joins by a key that
many rows may have (a band, a pivot, a class) deal such a key into parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bag_minhash as bag
from .common import Scratch, columns_of, drop_stored, held, rows_by_bytes, small_batches, spread_join, stored, texts_of
from .components import components

#: Weighted Jaccard similarity of multisets of five-word shingles from which two texts are near copies.
LEAST = 0.8
#: Pivots of a band in each round; None: all of its texts.
PIVOTS = (1, 3, None)
#: Classes of shingles in which the bounds are counted.
PARTS = 128
#: Texts of a block of a band.
BLOCK = 256
#: Rows of a key that one task joins, with and without texts.
TEXT_ROWS, ROWS = 256, 1024
GROUP_BYTES = 1 << 19


def _hashes() -> bag.WordHashes:
    """The worker's memo of word hashes."""
    return held(("words",), bag.WordHashes)


def _key(text: bytes) -> bytes:
    """A hash of a text's words."""
    return xxhash.xxh3_128_digest(b" ".join(text.split()))


def signed(docs: DataFrame, slots: int = bag.SLOTS) -> DataFrame:
    """doc_id, key, bands for every row whose text has a word; key: a hash of its words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_by_bytes(batches, GROUP_BYTES):
            raw = [t.encode() for t in texts]
            owner, item = bag.shingle_hashes(raw, _hashes())
            bands = bag.band_keys(bag.signatures(*bag.weighted(owner, item), len(raw), slots))
            some = np.flatnonzero(np.bincount(owner, minlength=len(raw)))
            keys = [_key(raw[i]) for i in some]
            flat = pa.array(bands[some].reshape(-1), pa.int64())
            offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands.shape[1])
            columns = [pa.array([ids[i] for i in some], pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(offsets, flat)]
            yield pa.record_batch(columns, ["doc_id", "key", "bands"])

    return texts_of(docs).where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, key binary, bands array<long>")


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, similarity of each of some stored pairs."""
    small_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            out = []
            for a, s, t in zip(batch.column("a").to_pylist(), batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                if a != last:  # pivots come one after the other
                    last, held = a, bag.multiset(s.encode(), _hashes())
                out.append(bag.overlap(held, bag.multiset(t.encode(), _hashes())))
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    of = lambda side: texts.select(F.col("doc").alias(side), F.col("text").alias(f"text_{side}"))
    counts = pairs.groupBy("a").agg(F.count("*").alias("count"))  # of the pairs alone, without texts
    joined = spread_join(spread_join(pairs, of("b"), "b", "a", TEXT_ROWS, hint="merge"), of("a"), "a", "b", TEXT_ROWS, counts, "merge")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def _bounds(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """doc, n, s, parts: a text's number of shingles, and of those that another text of ``docs`` holds too, in all and by PARTS."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [bag.multiset(t.encode(), _hashes()) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(x) for x in sets], np.int64)
            doc = batch.column("doc").take(pa.array(np.repeat(np.arange(len(sets)), sizes)))
            item = pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))
            yield pa.record_batch([doc, item], ["doc", "item"])

    items = texts.join(docs, "doc", "left_semi").select("doc", "text").mapInArrow(run, "doc long, item long")
    part = F.pmod("item", F.lit(PARTS)).cast("int").alias("part")
    alone = items.groupBy("item").agg(F.count("*").alias("c"), F.min("doc").alias("doc")).where("c = 1")
    each = items.select("doc", part, F.lit(1).alias("n"), F.lit(1).alias("s")).unionByName(alone.select("doc", part, F.lit(0).alias("n"), F.lit(-1).alias("s")))
    counted = each.groupBy("doc", "part").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    by_part = F.map_from_entries(F.collect_list(F.struct("part", "s")))
    rows = counted.groupBy("doc").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), by_part.alias("m"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    return rows.select("doc", "n", "s", parts.alias("parts"))


def _reaching(least: float, group: pa.Table) -> pa.Table:
    """The pairs a, b of a group that may be linked: of different components, a pivot among them, and sharing no
    less than the threshold needs; they share no more than either shares with any text, part by part.  A group
    is one block of a band and its pivots, or two blocks, of which only pairs across are made."""
    column = lambda name: group.column(name).combine_chunks()
    n, s, block, pivot, root = (column(c).to_numpy(zero_copy_only=False) for c in ("n", "s", "block", "pivot", "root"))
    parts = column("parts").flatten().to_numpy().reshape(len(n), -1).astype(np.int32)
    first = np.flatnonzero(block == block.min())
    second = np.flatnonzero(block == block.max())
    left, right = [], []
    for i in first:
        j = second[second > i] if block[i] == block[second[0]] else second
        common = np.minimum(s[i], s[j])
        j = j[(root[i] != root[j]) & (pivot[i] | pivot[j]) & (common >= least * (n[i] + n[j] - common))]
        common = np.minimum(parts[i], parts[j]).sum(axis=1)
        j = j[common >= least * (n[i] + n[j] - common)]
        left.append(np.full(len(j), i))
        right.append(j)
    docs = column("doc")
    return pa.table({"a": docs.take(pa.array(np.concatenate(left))), "b": docs.take(pa.array(np.concatenate(right)))})


def _met(opened: DataFrame, pivots: int | None, least: float) -> DataFrame:
    """Pairs a < b of texts that share a band and may be linked; see _reaching.

    A band's texts are dealt into blocks.  With some pivots, these go to every
    block and each block is a group; without, each two blocks (or one) are.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(F.lit(5), "doc"), blocks).cast("int")
    all_blocks = F.sequence(F.lit(0), blocks - 1)
    placed = opened.withColumn("own", own)
    if pivots is None:
        placed = placed.withColumn("pivot", F.lit(True)).withColumn("block", F.col("own")).withColumn("other", F.explode(all_blocks))
        grouped = placed.groupBy("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    else:
        placed = placed.withColumn("pivot", F.pmod(F.xxhash64(F.lit(pivots), "doc", "band"), F.col("size")) < pivots)
        placed = placed.withColumn("at", F.explode(F.when(F.col("pivot"), all_blocks).otherwise(F.array("own")))).withColumn("block", F.lit(0))
        grouped = placed.groupBy("band", "at")
    pairs = grouped.applyInArrow(lambda group: _reaching(least, group), "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _several(placed: DataFrame, least: float | None = None) -> DataFrame:
    """The rows of stored doc, band, root whose band has several components, with its size.

    With a threshold, of rows with n and s, and without the texts that can't
    reach it with any in the band.
    """
    own = [] if least is None else [F.min(F.col("n") - F.col("s")).alias("own")]
    kinds = [F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"), *own]
    bands = stored(placed.groupBy("band").agg(*kinds).where("low <> high").drop("low", "high"), "open")
    out = spread_join(placed, bands, "band", "doc", ROWS, bands.select("band", F.col("size").alias("count")))
    return out if least is None else stored(out.where(F.col("s") >= least * (F.col("n") + F.col("own"))).drop("own"), "opened")


def near_links(reps: DataFrame, texts_of_docs, least: float = LEAST) -> DataFrame | None:
    """Links a, b (of different texts) whose components are the classes; None if no two texts share a band.

    reps: doc, bands, one row a text; texts_of_docs: from a table with a column
    doc to doc, text.
    """
    bands = reps.select("doc", F.explode("bands").alias("band"))
    # a band's pivot is its smallest doc after flipping the bits that the band has
    flipped = F.col("doc").bitwiseXOR(F.col("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("size"), F.min(flipped).alias("x")).where("size > 1")
    shared = stored(shared.select("band", "size", F.col("x").bitwiseXOR(F.col("band")).alias("a")), "shared")
    if shared.isEmpty():
        return None
    bands = stored(spread_join(bands, shared.drop("size"), "band", "doc", ROWS, shared.select("band", F.col("size").alias("count"))), "bands")
    texts = stored(texts_of_docs(bands.select("doc").distinct()), "texts", "snappy")

    # the first round: every text of a band against the band's pivot
    pairs = stored(bands.where("doc <> a").select("a", F.col("doc").alias("b")).distinct(), "pairs")
    tested = stored(_compared(pairs, texts), "tested")
    links, bounds = tested.where(F.col("similarity") >= least), None
    for pivots in PIVOTS[1:]:
        roots = components(links)
        placed = bands.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").select("doc", "band", F.coalesce("root", "doc").alias("root"))
        if bounds is None:
            placed = stored(_several(stored(placed, "placed")).drop("size"), "placed")
            bounds = stored(_bounds(placed.select("doc").distinct(), texts), "bounds")
        # a text with too many shingles of its own is like no other one, at all or in its band
        able = stored(placed.join(bounds.drop("parts"), "doc").where(F.col("s") >= least * F.col("n")), "able")
        opened = _several(able, least)
        done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        met = _met(opened.join(bounds.select("doc", "parts"), "doc"), pivots, least)
        fresh = stored(met.join(done, ["a", "b"], "left_anti"), "pairs")
        if fresh.isEmpty():
            if pivots is None or opened.isEmpty():
                break
            continue
        tested = tested.unionByName(stored(_compared(fresh, texts), "tested"))
        links = tested.where(F.col("similarity") >= least)
    return links.select("a", "b")


def near_classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, class_id, class_size for every doc_id: near copies share the smallest doc_id of their class.

    Classes are the components of texts whose weighted Jaccard similarity is
    ``least`` or more; exact copies, by their words, have similarity 1.  A text
    of fewer than five words has one shingle, of all its words.  A null or empty
    text, or one of white space only, is like no other: a class of its own.
    Rows of one doc_id are one document, with the text whose hash is smallest;
    rows without a doc_id can't be named and have no row in the result.  Other
    columns are ignored; an empty table gives an empty table.
    """
    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = signed(docs).groupBy("doc_id").agg(F.min(F.struct("key", "bands")).alias("x"))
    rows = stored(rows.select("doc_id", "x.key", "x.bands"), "signed")
    reps = stored(rows.groupBy("key").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n"), F.first("bands").alias("bands")), "reps")

    def texts_of_docs(wanted: DataFrame) -> DataFrame:
        keyed = reps.select("doc", "key").join(wanted, "doc", "left_semi")
        found = texts_of(docs).withColumnRenamed("doc_id", "doc").join(keyed, "doc").mapInArrow(_own, "doc long, text string")
        return found.dropDuplicates(["doc"])

    with Scratch(docs.sparkSession) as scratch:
        links = near_links(reps.select("doc", "bands"), texts_of_docs, least)
        classes = reps.select("key", "doc", "n", F.col("doc").alias("root"))
        if links is not None:
            roots = components(links).select(F.col("node").alias("doc"), "root")
            classes = reps.select("key", "doc", "n").join(roots, "doc", "left").withColumn("root", F.coalesce("root", "doc"))
        # a node's root is the smallest doc_id of its class
        classes = stored(classes.select("key", "n", F.col("root").alias("class_id")), "classes")
        scratch.keep(classes)
    drop_stored(reps)
    total = classes.groupBy("class_id").agg(F.sum("n").alias("class_size"))
    of_key = spread_join(classes.select("key", "class_id"), total, "class_id", "key", ROWS)
    counts = classes.select("key", F.col("n").alias("count"))
    found = spread_join(rows.select("doc_id", "key"), of_key, "key", "doc_id", ROWS, counts).select("doc_id", "class_id", "class_size")
    return own.join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size")
    )


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, text of the rows whose text is the one that the key stands for, if a doc_id has several."""
    for batch in batches:
        fits = [_key(t.encode()) == k for t, k in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist())]
        yield batch.filter(pa.array(fits, pa.bool_())).select(["doc", "text"])


def drop_near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the document with the smallest doc_id stays.

    Rows of one doc_id are one document, of which one row stays; rows without a
    doc_id stay, and so do all columns, whatever their names.
    """
    classes = stored(near_classes(docs, least), "classes")
    gone = classes.where("doc_id <> class_id").select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti").select(columns_of(docs))
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = stored(repeated, "repeated")
    if repeated.isEmpty():
        return left
    again = left.join(repeated, "doc_id", "left_semi").select(columns_of(docs))
    return left.join(repeated, "doc_id", "left_anti").select(columns_of(docs)).unionByName(again.dropDuplicates(["doc_id"]))
