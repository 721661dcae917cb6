"""The corpus pipeline: each stage works on all that the one before it kept, written as Parquet and read again.

Defined cases: null and empty texts fail the quality rules and go with them; of equal or linked documents the smallest
doc_id stays; rows that share a doc_id are one document, so they stay or go together; an empty table gives an empty result;
extra columns pass through every stage but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import exact_dedup, packing, quality, simhash, suffix_dedup
from quillspark.llm.common import discard, docs_table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go."""
    return quality.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id stays."""
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link, the one with the smallest doc_id stays."""
    return simhash.keep_representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that an earlier document's 50-byte strings cover go; documents with nothing left go."""
    return suffix_dedup.without_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", best_fit_packing),
]

#: DuckDB has no XXH64 and no such tokenizer; tests/llm checks the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_table(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        last, docs = docs, written(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            discard(last)
    return docs
