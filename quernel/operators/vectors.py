"""Vector search: exact nearest neighbours by cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import csv_tags, has_all, starts_with_any
from ..functions.vectors import cosine, norm

#: Query vectors that a pass of a batch search takes, which are broadcast; those that a batch is multiplied with at a time.
MOST_QUERIES, AT_ONCE = 10_000, 512


def literal(vector) -> Column:
    return F.lit([float(x) for x in vector])


def scored(vectors: DataFrame, query, digits: int | None = None) -> DataFrame:
    """vectors with their cosine similarity to ``query``."""
    q = [float(x) for x in query]
    size = float(np.sqrt(np.sum(np.square(q))))
    score = cosine(F.col("embedding"), literal(q), b_norm=F.lit(size))
    return vectors.withColumn("score", F.round(score, digits) if digits else score)


def knn(vectors: DataFrame, query, limit: int, digits: int | None = None) -> DataFrame:
    """The ``limit`` nearest rows; none for a zero query.  Ties go by path and start_line."""
    if not any(query):
        return scored(vectors, query, digits).where("false")
    return scored(vectors, query, digits).orderBy(F.desc("score"), "path", "start_line").limit(limit)


def knn_batch(vectors: DataFrame, queries: DataFrame, limit: int, key: str = "vec_id", digits: int | None = None) -> DataFrame:
    """query_id, key, score, rank: the nearest rows of each query, by matrix products; with ``digits``, of rounded scores.

    queries: query_id, embedding, any number of rows.  Blocks of about
    MOST_QUERIES by the id's hash take one pass over ``vectors`` each.  Each batch
    keeps its own best, and only those are ranked.
    """
    blocks = max(1, -(-queries.count() // MOST_QUERIES))
    of = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = None
    for b in range(blocks):
        one = _nearest(vectors, queries.where(of == b), limit, key, digits)
        found = one if found is None else found.unionByName(one)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _nearest(vectors: DataFrame, queries: DataFrame, limit: int, key: str, digits: int | None) -> DataFrame:
    """query_id, key, score: each batch's nearest rows of one block of queries."""
    rows = queries.select("query_id", "embedding").collect()  # about MOST_QUERIES
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    every = np.array([r.query_id for r in rows], np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((every, unit(np.array([r.embedding for r in rows], np.float64)) if rows else None))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        everyone, matrix = shared.value
        for batch in batches:
            if not len(batch) or matrix is None:
                continue
            held, keys = unit(np.stack(batch["embedding"].to_numpy()).astype(np.float64)), batch[key].to_numpy()
            for at in range(0, len(everyone), AT_ONCE):
                ids = everyone[at : at + AT_ONCE]
                score = held @ matrix[at : at + AT_ONCE].T
                score = score if digits is None else np.round(score, digits)
                best = np.lexsort((np.broadcast_to(keys[:, None], score.shape), -score), axis=0)[:limit]
                each = np.broadcast_to(np.arange(len(ids)), best.shape)
                yield pd.DataFrame({"query_id": ids[each].ravel(), key: keys[best].ravel(), "score": score[best, each].ravel()})

    return vectors.select(key, "embedding").mapInPandas(run, f"query_id long, {key} long, score double")


def with_norm(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("norm", norm(F.col("embedding")))


def remove_paths(vectors: DataFrame, paths: DataFrame) -> DataFrame:
    return vectors.join(paths.select("path").distinct(), "path", "left_anti").select(vectors.columns)


def dimension(vectors: DataFrame) -> int | None:
    """The length of a stored vector; None if there is none."""
    row = vectors.select(F.size("embedding").alias("n")).first()
    return row.n if row else None


def semantic(vectors: DataFrame, query, limit: int, folders: list[str] | None = None, tags: list[str] | None = None, prefilter: bool = False, digits: int | None = None) -> DataFrame:
    """Search results of a query vector.

    Folders (any prefix) and tags (all) are looked at after the nearest
    ``limit`` rows are known, so fewer may be left; ``prefilter`` looks first.
    """

    def fits(df: DataFrame) -> DataFrame:
        if folders is not None:
            df = df.where(starts_with_any(F.col("path"), folders))
        if tags is not None:
            df = df.where(has_all(csv_tags(F.col("tags")), tags))
        return df

    hits = knn(fits(vectors), query, limit, digits) if prefilter else fits(knn(vectors, query, limit, digits))
    heading = F.coalesce("heading", F.lit(""))
    return hits.select("path", "title", F.col("text").alias("chunk"), "score", "start_line", "end_line", csv_tags(F.col("tags")).alias("tags"), heading.alias("heading"), F.lit("semantic").alias("match_type"))
