"""Full-text search: BM25 over title, body and tags.

A query compiles to one condition and one score, expressions over the places of
its words in each field.  These come from documents directly, in one scan each
for statistics and scores and without a shuffle, or from a stored inverted index
of which only the partitions and rows of the query's words are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.query_language import FIELDS, Clause, Term, parse, terms

K1, B = 1.2, 0.75
#: Partitions of the index by word, where the store doesn't say.
BUCKETS = 64


def documents(notes: DataFrame) -> DataFrame:
    """path, title, body, tags (joined by spaces) of notes whose tags are comma-separated."""
    return notes.select("path", "title", "body", F.replace("tags", F.lit(","), F.lit(" ")).alias("tags"))


def _atoms(query: Clause) -> list[tuple[str, str, tuple]]:
    """(field, kind, words) whose places the query needs: a word alone, or what a prefix, range or set matches."""
    out = {}
    for t in terms(query):
        for f in t.fields:
            if t.kind == "all":
                continue
            if t.kind in ("range", "set"):
                out[f, t.kind, (*t.words, *t.inclusive)] = None
            else:
                for i, w in enumerate(t.words):
                    last = t.kind == "prefix" and i == len(t.words) - 1
                    out[f, "prefix" if last else "term", (w,)] = None
    return list(out)


def _matches(token: Column, kind: str, words: tuple) -> Column:
    if kind == "prefix":
        return token.startswith(words[0])
    if kind == "range":
        low, high, from_low, to_high = words
        above = F.lit(True) if not low else (token >= low if from_low else token > low)
        return above & (F.lit(True) if not high else (token <= high if to_high else token < high))
    return token.isin(*words[:-2]) if kind == "set" else token == words[0]


def _once(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """path, title and columns that are worked out once a row.

    A generator of one row stands between them and their uses, into which the
    optimiser would otherwise copy them.
    """
    return docs.select("path", "title", F.explode(F.array(F.struct(*columns))).alias("row")).select("path", "title", "row.*")


def placed(docs: DataFrame, query: Clause) -> DataFrame:
    """path, title, dl_<field>, and p<n>: the places of the query's n-th atom."""
    words = {f: f"w_{f}" for f in FIELDS}
    split = _once(docs, [tokens(F.coalesce(f, F.lit(""))).alias(w) for f, w in words.items()])
    columns = [F.size(F.filter(w, lambda t: t.isNotNull())).alias(f"dl_{f}") for f, w in words.items()]
    for n, (f, kind, atom) in enumerate(_atoms(query)):
        if f == "path":
            places = F.when(_matches(F.col("path"), kind, atom), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        else:
            marked = F.transform(words[f], lambda t, i: F.when(F.coalesce(_matches(t, kind, atom), F.lit(False)), i))  # noqa: B023
            places = F.filter(marked, lambda i: i.isNotNull())
        columns.append(places.alias(f"p{n}"))
    return _once(split, columns)


def statistics(docs: DataFrame, query: Clause) -> dict:
    """Documents, mean lengths and document frequencies: one row, from one scan."""
    rows = placed(docs, query)
    n = len(_atoms(query))
    total = [F.sum(f"dl_{f}").alias(f"dl_{f}") for f in FIELDS]
    row = rows.agg(F.count("*").alias("docs"), *total, *(F.sum((F.size(f"p{i}") > 0).cast("long")).alias(f"df{i}") for i in range(n))).first()
    docs_n = row["docs"]
    return {"docs": docs_n, "mean": {f: (row[f"dl_{f}"] or 0) / docs_n if docs_n else 0.0 for f in FIELDS}, "df": [row[f"df{i}"] or 0 for i in range(n)]}


def _idf(stats: dict, atom: int) -> Column:
    n, df = stats["docs"], stats["df"][atom]
    return F.log(F.lit(1 + (n - df + 0.5) / (df + 0.5)))


def _followed(after: Column, low: int, high: int):
    """Whether a place has one of ``after`` that is ``low`` to ``high`` words on."""
    return lambda p: F.exists(after, lambda q: q.between(p + low, p + high))


def _compiled(query: Clause, stats: dict) -> tuple[Column, Column]:
    """Whether a row matches, and its score."""
    number = {a: n for n, a in enumerate(_atoms(query))}
    none = F.array().cast("array<int>")

    def in_field(t: Term, f: str) -> tuple[Column, Column]:
        if t.kind in ("range", "set"):
            hit = F.size(f"p{number[f, t.kind, (*t.words, *t.inclusive)]}") > 0
            return hit, hit.cast("double")
        last = len(t.words) - 1
        ids = [number[f, "prefix" if t.kind == "prefix" and i == last else "term", (w,)] for i, w in enumerate(t.words)]
        if not ids:
            return F.lit(False), F.lit(0.0)
        places = F.col(f"p{ids[0]}")
        for i, n in enumerate(ids[1:], 1):
            places = F.filter(places, _followed(F.col(f"p{n}"), i, i + t.slop))
        tf = F.size(F.coalesce(places, none)).cast("double")
        idf = reduce(lambda a, b: a + b, [_idf(stats, n) for n in ids])
        if f == "path":
            return tf > 0, (tf > 0).cast("double") * idf
        mean = stats["mean"][f] or 1.0
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(f"dl_{f}") / mean))
        return tf > 0, F.when(tf > 0, idf * weight).otherwise(0.0)

    def of(part) -> tuple[Column, Column]:
        if isinstance(part, Clause):
            must, may, never = ([of(p) for p in x] for x in (part.must, part.may, part.never))
            any_of = lambda parts: reduce(lambda a, b: a | b, [h for h, _ in parts], F.lit(False))
            hit = reduce(lambda a, b: a & b, [h for h, _ in must], F.lit(True)) if must else any_of(may)
            score = reduce(lambda a, b: a + b, [F.when(h, s).otherwise(0.0) for h, s in (*must, *may)], F.lit(0.0))
            return hit & ~any_of(never), score * part.boost
        if part.kind == "all":
            return F.lit(True), F.lit(1.0) * part.boost
        fields = [in_field(part, f) for f in part.fields]
        return reduce(lambda a, b: a | b, [h for h, _ in fields]), reduce(lambda a, b: a + b, [s for _, s in fields]) * part.boost

    return of(query)


def _top(rows: DataFrame, query: Clause, stats: dict, limit: int | None, digits: int | None) -> DataFrame:
    hit, score = _compiled(query, stats)
    out = rows.where(hit).select("path", "title", (F.round(score, digits) if digits else score).alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), "path").limit(limit)


def _holding(query: Clause) -> Column | None:
    """A condition that every match meets and that needs no words, if there is one: some searched word's letters are in the text."""

    def any_of(part) -> set[str] | None:
        if not isinstance(part, Clause):
            if part.kind not in ("phrase", "prefix", "set") or "path" in part.fields or not part.words:
                return None
            words = part.words if part.kind == "set" else part.words[:1]
            return set(words) if all(w.isascii() for w in words) else None
        found = [any_of(p) for p in (part.must or part.may)]
        if part.must:  # one of them will do
            return next((f for f in found if f), None)
        return set().union(*found) if found and all(found) else None

    words = any_of(query)
    if not words:
        return None
    lowered = [F.lower(F.coalesce(f, F.lit(""))) for f in FIELDS]
    return reduce(lambda a, b: a | b, [text.contains(w) for w in sorted(words) for text in lowered])


def search(docs: DataFrame, text: str, limit: int | None = 10, digits: int | None = None) -> DataFrame:
    """path, title, score of the best documents (path, title, body, tags) for a query; all if limit is None."""
    query = parse(text)
    if limit == 0:
        return docs.select("path", "title", F.lit(0.0).alias("score")).where("false")
    stats, holding = statistics(docs, query), _holding(query)
    return _top(placed(docs if holding is None else docs.where(holding), query), query, stats, limit, digits)


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """field, term, path, positions of rows with a list of words for each field: sorted within a batch, no shuffle."""
    for batch in batches:
        for field in FIELDS:
            words = batch.column(field)
            sizes = np.diff(words.offsets.to_numpy())
            row = np.repeat(np.arange(len(words)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            term = words.flatten()
            kept = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
            if not len(kept):
                continue
            coded = term.take(pa.array(kept)).dictionary_encode()
            key = row[kept] * len(coded.dictionary) + coded.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            held = key[order]
            start = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
            positions = pa.ListArray.from_arrays(pa.array(np.append(start, len(held)), pa.int32()), pa.array(place[kept][order], pa.int32()))
            rows, codes = np.divmod(held[start], len(coded.dictionary))
            columns = [pa.array([field] * len(start)), coded.dictionary.take(pa.array(codes)), batch.column("path").take(pa.array(rows)), positions]
            yield pa.record_batch(columns, ["field", "term", "path", "positions"])


def postings(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """field, term, path, positions, bucket of every word of every document; words meet within their document's row."""
    split = docs.select("path", *(tokens(F.coalesce(f, F.lit(""))).alias(f) for f in FIELDS))
    grouped = split.mapInArrow(_grouped, "field string, term string, path string, positions array<int>")
    return grouped.withColumn("bucket", bucket(F.col("term"), buckets))


def lengths(docs: DataFrame) -> DataFrame:
    """path, title, dl_<field> of every document."""
    return docs.select("path", "title", *(F.size(F.filter(tokens(F.coalesce(f, F.lit(""))), lambda t: t.isNotNull())).alias(f"dl_{f}") for f in FIELDS))


def search_index(index: DataFrame, documents: DataFrame, text: str, limit: int | None = 10, digits: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """As search, over stored postings and lengths.

    Words are looked up by bucket, so only their partitions of the index are
    read; prefixes and ranges read all of them.  Documents without any of the
    words are read only for a query that can match them.
    """
    query = parse(text)
    atoms = _atoms(query)
    total = documents.agg(F.count("*").alias("docs"), *(F.sum(f"dl_{f}").alias(f) for f in FIELDS)).first()
    wanted, exact = F.lit(False), True
    for f, kind, words in atoms:
        exact &= kind in ("term", "set") and f != "path"
        if f != "path":
            wanted = wanted | ((F.col("field") == f) & _matches(F.col("term"), kind, words))
    found = index.where(wanted)
    if exact and atoms:  # the words themselves, so that files are read by bucket and row groups by word
        plain = sorted({w for _, kind, words in atoms for w in (words[:-2] if kind == "set" else words)})
        hashes = index.sparkSession.range(1).select(F.explode(F.array(*(bucket(F.lit(w), buckets) for w in plain))).alias("b")).distinct().collect()
        found = found.where(F.col("bucket").isin([r.b for r in hashes]) & F.col("term").isin(plain))
    collected = [
        F.sort_array(F.flatten(F.collect_list(F.when((F.col("field") == f) & _matches(F.col("term"), kind, words), F.col("positions"))))).alias(f"p{n}")
        for n, (f, kind, words) in enumerate(atoms)
        if f != "path"
    ]
    empty = F.array().cast("array<int>")
    everything = any(t.kind == "all" or "path" in t.fields for t in terms(query)) or not collected
    rows = documents if not collected else documents.join(found.groupBy("path").agg(*collected), "path", "left" if everything else "inner")
    for n, (f, kind, words) in enumerate(atoms):
        at_path = F.when(_matches(F.col("path"), kind, words), F.array(F.lit(0))).otherwise(empty)
        rows = rows.withColumn(f"p{n}", at_path if f == "path" else F.coalesce(f"p{n}", empty))
    row = rows.agg(*(F.sum((F.size(f"p{n}") > 0).cast("long")).alias(f"df{n}") for n in range(len(atoms)))).first() if atoms else {}
    n = total["docs"]
    stats = {"docs": n, "mean": {f: (total[f] or 0) / n if n else 0.0 for f in FIELDS}, "df": [row[f"df{i}"] or 0 for i in range(len(atoms))]}
    return _top(rows, query, stats, limit, digits)
