"""A training corpus from raw documents: five stages, each an operator of visarium.llm on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from visarium.llm.chunks import tokenizer_path
from visarium.llm.decontaminate import drop_contaminated
from visarium.llm.exact_dedup import drop_exact_copies
from visarium.llm.language import drop_unidentified
from visarium.llm.packing import packed
from visarium.llm.simhash import drop_near_copies
from visarium.llm.tables import delete, scope, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without any letter go."""
    return drop_unidentified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return drop_exact_copies(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id. Near copies are op2_simhash's: fingerprints of
    3-word shingles within 2 of 64 bits, not a Jaccard similarity; README.md says how many others stay."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages to speak of."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packed(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language", identify_language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", pack)]

#: No SQL: language identification, fingerprints and token ids are beyond it. tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; what a stage keeps is written before the next reads it. A stage's own tables, and the
    input that it has read, are then deleted; those that the result is read from stay with the caller."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scope(spark) as paths:
            kept = stored(stage(spark, docs, sf_dir), name)
            path = paths.pop()
        if before is not None:
            delete(spark, before)
        docs, before = kept, path
    return STAGES[-1][1](spark, docs, sf_dir)
