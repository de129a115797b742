"""The registered queries of the training-data operators: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyfold.llm import exact_dedup, line_dedup, near_dedup, substring_dedup
from manyfold.llm.bpe import bpe_encode
from manyfold.llm.common import given_id, table
from manyfold.llm.decontaminate import find_leaks
from manyfold.llm.quality import fold_is_not, quality_scores
from manyfold.llm.secrets import secret_scan
from manyfold.llm.sharding import shard
from manyfold.llm.toxicity import toxicity_scores

SHARDS = 8


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _with_doc_id(rows: DataFrame, *columns) -> DataFrame:
    return rows.select(given_id("_id").alias("doc_id"), *columns)


def op1_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = shard(_documents(spark, sf_dir), SHARDS)
    return _with_doc_id(rows, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan(_documents(spark, sf_dir))
    return _with_doc_id(rows, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked")


def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = bpe_encode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return _with_doc_id(rows, "n_tokens", "ids_sha256", "decoded_sha256")


def op4_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(_documents(spark, sf_dir))
    return _with_doc_id(rows, "keep_id", "group_size", "kept", "text_sha256")


def op5_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_leaks(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return _with_doc_id(rows, "item_id", "edits", "first_word", "n_words")


def _held_out(fold: int, folds: int):
    id_col = given_id("_id")
    return F.coalesce((F.crc32(id_col.cast("string").cast("binary")) % folds) == fold, F.lit(False)).alias("held_out")


def op6_quality_fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_scores(_documents(spark, sf_dir), table(spark, sf_dir, "labels"), fold_is_not(1, 3))
    return _with_doc_id(rows, _held_out(1, 3), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity_scores(_documents(spark, sf_dir), table(spark, sf_dir, "labels"), fold_is_not(2, 4))
    return _with_doc_id(rows, _held_out(2, 4), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.substring_dedup(_documents(spark, sf_dir))
    return _with_doc_id(rows, "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_chosen_path_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dedup.near_dedup(_documents(spark, sf_dir), shingle=4, similarity=80)
    return _with_doc_id(rows, "n_shingles", "component_id", "kept")


def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(_documents(spark, sf_dir))
    return _with_doc_id(rows, "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_virtual_slot_sharding,
        op2_secret_scan,
        op3_prefix_bpe,
        op4_bloom_exact_dedup,
        op5_cgk_decontamination,
        op6_quality_fourier,
        op7_weak_toxicity,
        op8_difference_cover_dedup,
        op9_chosen_path_near_dedup,
        op10_line_runs,
    )
}

ORACLES: dict[str, str] = {
    "op4_bloom_exact_dedup": exact_dedup.ORACLE,
    "op8_difference_cover_dedup": substring_dedup.ORACLE,
    "op9_chosen_path_near_dedup": near_dedup.ORACLE,
    "op10_line_runs": line_dedup.ORACLE,
}
