"""The corpus pipeline: documents without toxic ones, copies, near copies and benchmark leaks, as token ids.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents unchanged. Nulls, empty
tables and repeated rows are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from manyfold.llm.bpe import bpe_encode
from manyfold.llm.common import given_id, remove_written, table, tables_written, written
from manyfold.llm.decontaminate import drop_leaks
from manyfold.llm.exact_dedup import drop_copies
from manyfold.llm.near_dedup import drop_near_copies
from manyfold.llm.quality import fold_is_not
from manyfold.llm.toxicity import drop_toxic

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.3 or more; labels of the rows that op7 holds out aren't used here either."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), fold_is_not(2, 4))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 on five-word shingles, the one with the smallest id."""
    return drop_near_copies(docs, shingle=5, similarity=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the token ids and the hashes of the ids and of the decoded bytes."""
    rows = bpe_encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)
    return rows.select(given_id("_id").alias("doc_id"), "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Learnt scores, LSH and BPE are beyond SQL. The tests hold the dedup, decontamination and encoding stages against brute
#: force and the toxicity stage against the labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's rows are written before the next one reads them; what else the stage wrote, and
    the rows that it read, are removed then. The last stage's tables stay, as its rows are read later."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        began = tables_written()
        kept = written(stage(spark, docs, sf_dir), f"stage-{name}")
        remove_written(spark, max(began - 1, 0) if name != STAGES[0][0] else began, tables_written() - 1)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
