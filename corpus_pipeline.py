"""Corpus pipeline: language identification, near-duplicate removal, benchmark decontamination, mixing, token files.

Each stage reads the Parquet files of the stage before, so a lost executor costs at most the tasks of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from claimgrid.llm import decontaminate, language_id, mixing, near_copies, token_store
from claimgrid.llm.common import stored, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text no learned language explains go (null and letterless texts among them); lang becomes the prediction."""
    return language_id.keep_identified(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays: texts at least 0.8 alike on five-word shingles, and
    what such pairs join.

    SimHash on two-word shingles at five bits, with MinHash bands beside it, only proposes; the exact likeness decides.
    """
    return near_copies.keep_one(docs, shingle=2, bits=5)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands, within its edit budget, go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix draws it, shuffled inside its output shard."""
    return mixing.mixed_rows(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix in files, and per document what is read back from them: doc_id, start, n_tokens, ids_crc32."""
    return token_store.read_documents(token_store.write_tokens(docs, TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]

#: Fingerprints, models, edit distances and token ids can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
