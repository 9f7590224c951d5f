"""A corpus pipeline: each stage works on all documents that the one before it kept.

Quality rules drop documents; of near duplicates the one with the least doc_id stays; documents that hold benchmark
items go; personal data gives way to marks; what is left is packed into training sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontamination import decontaminate
from tidemark.llm.near_copies import keep_one
from tidemark.llm.packing import pack_documents
from tidemark.llm.pii import redact
from tidemark.llm.quality_rules import keep_documents
from tidemark.llm.shared import scratch_dir

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that the quality rules reject go; all columns stay. Null and empty texts have too few words. Equal rows fare alike."""
    return keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: of near copies (5-word shingles, Jaccard similarity 0.8 or more, linked through any number of others) the row of least
    doc_id stays, of equal rows one; rows without a doc_id come last. Null and empty texts are copies of each other."""
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: documents that hold a copy of a benchmark item, edited or not, go. Null and empty texts hold none."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: personal data in text gives way to marks; all rows and other columns stay, a null text too."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: all documents as pieces of sequences of at most 2048 ids, with their ids. A null text counts as empty: a piece of the end id."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("decontamination", benchmark), ("pii", personal_data), ("best_fit_packing", packing)]

#: SQL has no word alignment, no trained span classifier and no tokenizer; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of sf_dir's documents; no documents, no pieces. Each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
