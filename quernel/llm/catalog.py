"""The registered queries of the corpus operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, line_dedup
from .bpe import bpe_digests
from .common import table
from .decontaminate import contaminated
from .language_id import identify
from .near_dedup import near_classes
from .quality import quality_rules
from .token_counts import token_counts
from .token_files import token_files
from .url_filter import filter_urls


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_chat": op1_chat,
    "op2_url_filter": op2_url_filter,
    "op3_line_dedup": op3_line_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_token_counts": op6_token_counts,
    "op7_bpe": op7_bpe,
    "op8_language_id": op8_language_id,
    "op9_quality": op9_quality,
    "op10_token_files": op10_token_files,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat": chat.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
}
