"""Benchmark decontamination (operator 5): latent semantic retrieval, then alignment.

Passages are blocks of 32 words and pairs of neighbouring blocks, as TF-IDF
vectors over the benchmark's terms; no other term can add to a similarity with
an item.  Columns are all informative terms of the items, so a paraphrase that
replaces an item's rarest words is found by the others.  The passages' singular
vectors come from a randomised SVD in one distributed pass: every task adds up its
share of G * Omega, where G is the Gram matrix of all passages, of documents and
benchmark alike, and the Nystrom formula on the sum gives the leading ones.

A passage is a candidate for an item if their cosine in the latent space reaches
a threshold.  A candidate counts if the longest common subsequence of words
covers enough of the item, or less of it but also its answer, the last sentence.

What tasks share is bounded: the terms are hashed to at most COLUMNS columns, the
space has RANK dimensions, and a benchmark of more than BLOCK_ITEMS items is
searched for in blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, map_rows, rows_by_bytes, small_batches, stored, texts_of

RANK, EXTRA, COLUMNS, BLOCK_ITEMS = 256, 16, 1 << 15, 20_000
WORDS = 32
#: Cosine of a candidate; share of an item's words in order that tells alone; share that tells together with the answer.
COSINE, ALONE, WITH_ANSWER, ANSWER = 0.25, 0.7, 0.5, 0.8
#: In an item of fewer than LONG words, of which chance can put half into a passage, an answer of fewer than SHORT words is
#: replaced by so many words at the item's end.
SHORT, LONG = 8, 24
#: A term of more than this share of the items (and of more than two) isn't informative.
COMMON = 0.02
#: A passage has so many of the columns' terms at least, or a third of the terms of the item with the fewest.
LEAST_TERMS = 3
GROUP_BYTES = 2 << 20
#: Columns of a row of partial sums, and groups of tasks that are added up first.
PART, SALTS = 64, 32
#: Rows that are gathered and added at a time, so that they stay in the cache; terms of documents that are sketched at a time.
CACHED, SKETCHED = 1024, 1 << 16


#: ASCII marks as spaces.
TABLE = bytes.maketrans(b".,;:!?\"'()[]{}", b"              ")


def words_of(text: str) -> list[bytes]:
    """A text's words, lower-cased, without ASCII marks."""
    return text.lower().encode().translate(TABLE).split()


@dataclass
class Item:
    item_id: int | None
    words: list[bytes]
    answer: list[bytes]

    def __post_init__(self):
        self.held = frozenset(self.words)
        self.again, self.least = len(self.words) - len(self.held), WITH_ANSWER * len(self.words)

    @classmethod
    def of(cls, item_id: int | None, text: str) -> Item:
        sentences = [s for s in re.split(r"(?<=[.?!])\s+", text.strip()) if s]
        words = words_of(text)
        answer = words_of(sentences[-1]) if sentences else []
        least = 1 if len(words) >= LONG else SHORT
        return cls(item_id, words, answer if least <= len(answer) < len(words) else words[-SHORT:])


def common_length(pattern: list[bytes], text: list[bytes]) -> int:
    """Length of the longest common subsequence, by bits of the pattern."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    row = full
    for w in text:
        if m := at.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(pattern) - row.bit_count()


def run_sums(table: np.ndarray, index: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the table's rows at ``index``, over the runs that begin at ``start``."""
    cut = np.append(start, len(index))
    out = np.empty((len(start), table.shape[1]), table.dtype)
    a = 0
    while a < len(start):
        b = min(len(start), max(a + 1, int(np.searchsorted(cut, cut[a] + CACHED))))
        np.add.reduceat(table[index[cut[a] : cut[b]]], start[a:b] - cut[a], axis=0, out=out[a:b])
        a = b
    return out


@dataclass
class Space:
    """Terms to columns, the columns' weights, and what a search needs of the items."""

    column: dict[bytes, int]
    width: int
    weight: np.ndarray | None = None  # idf
    basis: np.ndarray | None = None  # columns x rank, weighted
    items: list[Item] = field(default_factory=list)
    queries: np.ndarray | None = None  # items x rank, of length 1
    least: int = 1

    @classmethod
    def of(cls, items: list[Item]) -> Space:
        spread = Counter(w for i in items for w in set(i.words))
        most = max(2, COMMON * len(items))
        kept = {w for w, c in spread.items() if c <= most}
        # an item with few informative terms keeps all of its terms
        kept |= {w for i in items if len(kept & set(i.words)) < 5 for w in i.words}
        terms = sorted(kept)
        if len(terms) <= COLUMNS:
            return cls({w: i for i, w in enumerate(terms)}, len(terms), items=items)
        return cls({w: xxhash.xxh3_64_intdigest(w) % COLUMNS for w in terms}, COLUMNS, items=items)

    def terms(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, position, column) of every term of a column."""
        owner, place, column = [], [], []
        for n, text in enumerate(texts):
            tokens = words_of(text)
            got = np.fromiter(map(self.column.get, tokens, repeat(-1)), np.int32, len(tokens))
            at = np.flatnonzero(got >= 0)
            owner.append(np.full(len(at), n))
            place.append(at)
            column.append(got[at])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *owner]), np.concatenate([none, *place]), np.concatenate([none, *column])

    def weigh(self, frequency: np.ndarray, documents: float) -> None:
        """Sets the columns' idf, and how many terms a passage has at least."""
        fewest = min(len({w for w in i.words if w in self.column}) for i in self.items)
        self.least = max(1, min(LEAST_TERMS, fewest // 3))
        self.weight = 1 + np.log((1 + documents) / (1 + frequency))

    def passages(self, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the blocks within the terms, and which blocks are followed by the next one of their text."""
        block = place // WORDS
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])])
        start = np.flatnonzero(new)
        o, b = owner[start], block[start]
        pair = np.flatnonzero((o[1:] == o[:-1]) & (b[1:] == b[:-1] + 1))
        return start, pair

    def vectors(self, owner: np.ndarray, place: np.ndarray, column: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (passages times ``table``), each one's first block's start, and the blocks with a next one."""
        start, pair = self.passages(owner, place)
        blocks = run_sums(table, column, start)
        return np.concatenate([blocks, blocks[pair] + blocks[pair + 1]]), start, pair

    def find(self, texts: list[str]) -> list[tuple[int, int, float, float, bool]]:
        """(text number, item number, cosine, share of the item in order, answer found) of every contaminated pair."""
        owner, place, column = self.terms(texts)
        if not len(owner):
            return []
        rows, start, pair = self.vectors(owner, place, column, self.basis)
        count = np.diff(np.append(start, len(column)))
        full = np.flatnonzero(np.concatenate([count, count[pair] + count[pair + 1]]) >= self.least)
        rows = rows[full]
        first = np.concatenate([start, start[pair]])[full]
        size = np.concatenate([np.full(len(start), WORDS), np.full(len(pair), 2 * WORDS)])[full]
        length = np.linalg.norm(rows, axis=1)
        best: dict[tuple[int, int], list] = {}
        for at in range(0, len(rows), 8192):
            part = slice(at, at + 8192)
            cosine = rows[part] @ self.queries.T / np.maximum(length[part], 1e-12)[:, None]
            for r, i in np.argwhere(cosine >= COSINE).tolist():
                t, p = int(owner[first[at + r]]), int(place[first[at + r]]) // WORDS * WORDS
                spans = best.setdefault((t, i), [0.0, []])
                spans[0] = max(spans[0], float(cosine[r, i]))
                spans[1].append((p, p + int(size[at + r])))
        out, split = [], {}
        for (t, i), (cosine, spans) in sorted(best.items()):
            item = self.items[i]
            if t not in split:
                split = {t: words_of(texts[t])}
            words, share, answered = split[t], 0.0, False
            for a, b in _joined(spans, len(item.words)):
                # a common subsequence has each different word of the item that is here once, and its repeats at most
                if len(item.held.intersection(words[a:b])) + item.again < item.least:
                    continue
                near = [w for w in words[a:b] if w in item.held]
                if len(near) < item.least or (length := common_length(item.words, near)) < item.least:
                    continue
                answer = common_length(item.answer, near) >= ANSWER * len(item.answer)
                share, answered = max((share, answered), (length / len(item.words), answer))
            if share >= ALONE or share >= WITH_ANSWER and answered:
                out.append((t, i, cosine, share, answered))
        return out


def _joined(spans: list[tuple[int, int]], around: int) -> Iterator[tuple[int, int]]:
    """Spans with as many words on either side as the item has, in pieces of bounded length that overlap."""
    reach = 0
    for a, b in sorted(set(spans)):
        a, b = max(0, a - around), b + around
        if b > reach:
            yield a, b
            reach = b


def sketched(space: Space, owner: np.ndarray, place: np.ndarray, column: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """G * Omega for the passages of some texts."""
    total = np.zeros(omega.shape, np.float64)
    if not len(owner):
        return total
    rows, start, pair = space.vectors(owner, place, column, (omega * space.weight[:, None]).astype(np.float32))
    # each block takes part by itself and in a pair with each neighbour
    back = rows[: len(start)].copy()
    back[pair] += rows[len(start) :]
    back[pair + 1] += rows[len(start) :]
    of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(column))))
    order = np.argsort(column, kind="stable")
    held = column[order]
    at = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    total[held[at]] = run_sums(back, of[order], at) * space.weight[held[at], None]
    return total


TERMS = "place array<int>, column array<int>"


def _term_table(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in rows_by_bytes(batches, GROUP_BYTES):
        owner, place, column = shared.value.terms(texts)
        cuts = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (place, column)]
        yield pa.record_batch(lists, ["place", "column"])


def _partials(kind: str, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's share of the document frequencies ("df") or of the sketch ("sketch"), PART columns a row."""
    space, omega = shared.value
    width = 1 if kind == "df" else omega.shape[1]
    total, energy = np.zeros((-(-space.width // PART) * PART, width)), 0.0
    for batch in batches:
        lists = batch.column("column")
        column = lists.flatten().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy())
        if kind == "df":
            seen = np.unique(owner * space.width + column) % space.width
            total[:, 0] += np.bincount(seen, minlength=len(total))
            continue
        place = batch.column("place").flatten().to_numpy()
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))  # of each document's terms
        pieces = np.unique(first[np.searchsorted(first, np.arange(0, len(owner), SKETCHED), "right") - 1])
        for a, b in zip(pieces, [*pieces[1:], len(owner)]):
            total[: space.width] += sketched(space, owner[a:b], place[a:b], column[a:b], omega)
        energy += float((space.weight[column] ** 2).sum())
    parts = np.flatnonzero(total.reshape(-1, PART * width).any(axis=1))
    blobs = [total[p * PART : (p + 1) * PART].tobytes() for p in parts]
    extra = [np.array([energy]).tobytes()] if energy else []
    yield pa.record_batch([pa.array([*parts.tolist(), *[-1] * len(extra)], pa.int32()), pa.array(blobs + extra, pa.binary())], ["part", "sums"])


def _added(key: tuple, group: pa.Table) -> pa.Table:
    total = 0
    for blob in group.column("sums"):
        total = total + np.frombuffer(blob.as_buffer())
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([np.asarray(total, np.float64).tobytes()], pa.binary())})


def _gathered(terms: DataFrame, kind: str, space: Space, omega: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """The sums over all rows of a term table: (columns x width), and their energy."""
    shared = terms.sparkSession.sparkContext.broadcast((space, omega))
    partials = terms.mapInArrow(partial(_partials, kind, shared), "part int, sums binary")
    # a few tasks' partial sums are added before those of all tasks meet
    salted = partials.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    once = salted.groupBy("part", "salt").applyInArrow(_added, "part int, sums binary")
    width = 1 if kind == "df" else omega.shape[1]
    total, energy = np.zeros((-(-space.width // PART) * PART, width)), 0.0
    for part, sums in once.groupBy("part").applyInArrow(_added, "part int, sums binary").collect():  # COLUMNS / PART rows at most
        values = np.frombuffer(bytes(sums))
        if part < 0:
            energy = float(values[0])
        else:
            total[part * PART : (part + 1) * PART] = values.reshape(PART, width)
    return total[: space.width], energy


def leading(sketch: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """The leading eigenvectors of a positive semidefinite G from G * Omega, by the Nystrom formula."""
    shift = 1e-7 * np.linalg.norm(sketch)
    shifted = sketch + shift * omega
    values, vectors = np.linalg.eigh((core := omega.T @ shifted) / 2 + core.T / 2)
    kept = values > 1e-12 * values.max()
    half = shifted @ (vectors[:, kept] / np.sqrt(values[kept]))
    left, single, _ = np.linalg.svd(half, full_matrices=False)
    return left[:, : min(rank, int((single**2 > shift).sum()))]


def fit(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> Space | None:
    """The latent space of the passages of ``docs`` and of one block of the benchmark; None if that has no words."""
    rows = benchmark.where("text IS NOT NULL").collect()  # about BLOCK_ITEMS at most
    items = [i for r in sorted(rows, key=lambda r: (r.item_id is not None, r.item_id, r.text)) if (i := Item.of(r.item_id, r.text)).words]
    if not items:
        return None
    space = Space.of(items)
    shared = docs.sparkSession.sparkContext.broadcast(space)
    terms = stored(docs.mapInArrow(partial(_term_table, shared), TERMS), "terms")
    frequency, _ = _gathered(terms, "df", space)
    space.weigh(frequency[:, 0], float(terms.count()))
    omega = np.random.default_rng(17).standard_normal((space.width, min(space.width, rank + EXTRA)))
    sketch, energy = _gathered(terms, "sketch", space, omega)
    drop_stored(terms)
    owner, place, column = space.terms([b" ".join(i.words).decode() for i in items])
    own, own_energy = sketched(space, owner, place, column, omega), float((space.weight[column] ** 2).sum())
    # documents and benchmark have half of the energy each
    basis = leading(sketch / max(energy, 1e-12) + own / max(own_energy, 1e-12), omega, rank)
    whole = np.zeros((len(items), space.width))
    np.add.at(whole, (owner, column), space.weight[column])
    space.basis = (basis * space.weight[:, None]).astype(np.float32)
    queries = whole @ basis
    space.queries = (queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return space


def _spaces(docs: DataFrame, benchmark: DataFrame) -> list[Space]:
    items = benchmark.select("item_id", "text").distinct()
    blocks = -(-items.count() // (BLOCK_ITEMS * 9 // 10))  # dealt by hash, so a block may have some more than its share
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    return [s for b in range(blocks) if (s := fit(texts_of(docs), items.where(of == b)))]


PAIRS = "doc_id long, item_id long, cosine double, share double, answered boolean"


def _pairs(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in rows_by_bytes(batches, GROUP_BYTES):
        found = [(ids[t], shared.value.items[i].item_id, c, s, a) for t, i, c, s, a in shared.value.find(texts)]
        columns = list(zip(*found)) or [()] * 5
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in PAIRS.split(", ")])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, share, answered of every document that holds a benchmark item.

    share: of the item's words, in order, near the passage; answered: whether
    most of its last sentence is there too.  Null and empty texts hold nothing,
    and an empty benchmark gives an empty result.  Repeated documents give
    repeated rows, repeated items count once; null ids stay null; other columns
    are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = None
    for space in _spaces(docs, benchmark):
        shared = spark.sparkContext.broadcast(space)
        found = texts_of(docs).mapInArrow(partial(_pairs, shared), PAIRS)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], PAIRS) if out is None else out


def _clean(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bad = {t for t, *_ in shared.value.find([t or "" for t in batch.column("text").to_pylist()])}
        if len(bad) < batch.num_rows:
            yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)]))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item; see ``contaminated``."""
    spark = docs.sparkSession
    small_batches(spark)
    out = docs
    for space in _spaces(docs, benchmark):
        out = map_rows(out, partial(_clean, spark.sparkContext.broadcast(space)))
    return out
