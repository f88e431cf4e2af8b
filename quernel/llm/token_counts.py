"""Token counts (operator 6): Arrow batches in, lengths out.

Batches are dealt anew by bytes of text rather than by rows, long texts are
split at safe boundaries where the tokenizer has any, and only lengths leave the
worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_by_bytes, small_batches, texts_of
from .word_pieces import length_encoder, tokenizer_path

#: Bytes of text that are worked on at once.
BATCH_BYTES = 1 << 20


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    A null or empty text has 0 bytes and 0 tokens; repeated rows give repeated
    rows; a null doc_id stays null; other columns are ignored; an empty table
    gives an empty table.  Texts of any length are counted whole.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = length_encoder(tokenizer_path(tokenizer))
        for ids, texts in rows_by_bytes(batches, BATCH_BYTES):
            parts = [encoder.pieces(t) for t in texts]
            encoder.encode_batch(set().union(*(p for t in parts for p in t)))
            lengths = [sum(sum(map(encoder.__getitem__, p)) for p in t) for t in parts]
            yield pa.record_batch(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(lengths, pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = texts_of(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
