"""The corpus pipeline: five operators of quernel.llm, one after the other.

Each stage works on all that the one before it kept.  Between stages the
documents are a Parquet table in the shared folder.  A stage needs the columns
doc_id and text, the first one lang too; all others pass through, whatever their
names.  Null and empty texts have no language and go first; rows of one doc_id
are one document, of which near-dedup keeps a row; rows without a doc_id keep
their lines and have no near copies; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.bpe import bpe_tokens
from quernel.llm.common import Scratch, drop_stored, stored, table
from quernel.llm.decontaminate import drop_contaminated
from quernel.llm.language_id import keep_identified
from quernel.llm.line_dedup import dedup_lines
from quernel.llm.near_dedup import drop_near_copies


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go, except from the last document that holds them; n_chars, if there, follows the text."""
    return dedup_lines(docs, counted=False, counted_chars="n_chars" if "n_chars" in docs.columns else None)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the text decoded from them."""
    encoded = bpe_tokens(docs)
    digits = F.array_join("ids", ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(digits, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("bpe", tokens),
]

#: Language ID, near copies and decontamination have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with Scratch(spark) as scratch:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", "snappy")
            scratch.keep(docs)
        drop_stored(before)  # what the stage before it left
    return STAGES[-1][1](spark, docs, sf_dir)
