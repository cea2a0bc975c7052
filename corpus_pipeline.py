"""A corpus pipeline of five stages over `documents`: each gets what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. STAGES can be
run one by one, each result written as Parquet and read again as the next one's docs; `run` does the same with checkpoints in
the cluster's shared folder.

Rows with null texts, empty texts or repeated rows go through as the operators' docstrings say: a document without ten words is
rejected by the first stage; of rows with the same id the second keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leadmill.llm import packing, quality_rules, secret_scan, simhash, substring_dedup
from leadmill.llm.common import documents, reliable


#: Bits in which near copies may differ. On 51,000 documents 0.92 of the near copies (0.8 or more of their five-word shingles in common) are caught at 8, 0.75 at 6, 0.17 at 2.
RADIUS = 8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays; fingerprints link at RADIUS or fewer differing bits."""
    return simhash.keep_one(docs, radius=RADIUS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur earlier go from the texts; n_chars follows."""
    return substring_dedup.remove_repeats(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows."""
    return secret_scan.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("substring_dedup", substrings), ("secret_scan", secrets), ("packing", pack)]

#: Packing needs a tokenizer and the secret scan a trained network; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = reliable(docs)
    return docs
