"""Corpus pipeline: quality rules, near copies, repeated passages, secrets, packing.

Each stage reads what its predecessor kept, as written to the folder that driver and executors share. The first four
return the columns of documents: the first drops rejected documents and failing lines, the second all but one document
of each class of near copies (five-word shingles, similarity 0.8 or more), the third repeated passages, the fourth puts marks in place of live-looking secrets. The
last returns the pieces with their places.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pixelmill.llm import nearcopies, packing, quality, secrets, suffix
from pixelmill.llm.common import Scratch, table, with_length


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.keep_representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.keep_first_passages(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_length(secrets.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: SQL has neither the signatures nor the tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir), name.split()[0])
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
