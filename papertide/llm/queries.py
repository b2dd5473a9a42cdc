"""One query for each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, filter_audit, hnsw, mixing, order_minhash, quality, rolling, secrets, sharding, syncmers, token_counts, token_files, url_filter
from .common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.classes(table(spark, sf_dir, "embeddings"))


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.by_bytes(table(spark, sf_dir, "documents"))


def op4_url_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_and_read(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op7_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def op9_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_likeness(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.over_limit(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.reported(table(spark, sf_dir, "documents"))


def op13_rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.before_each(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_hnsw, op3_histogram_sort, op4_url_digests, op5_simple8b_files, op6_mixing, op7_neighbour_votes, op8_order_minhash, op9_closed_syncmers, op10_token_counts, op11_filter_audit, op12_trigram_secrets, op13_rolling_windows)}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_digests": url_filter.SQL, "op11_filter_audit": filter_audit.SQL, "op12_trigram_secrets": secrets.SQL, "op13_rolling_windows": rolling.SQL}
