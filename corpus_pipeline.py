"""A training corpus from the documents: each stage works on all rows that the one before it kept, written as Parquet between them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontam, exact_dedup, langid, packing, simhash
from palimpsest.llm.common import cleanup, collected, remove, work_dir, written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language: those without a text or a letter go, and those that no mixture of the languages learned explains
    better than chance."""
    found = langid.identify(docs, langid.fit(docs))
    return found.where("out.known").select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks the longest stays, of those the one with the smallest identifier."""
    collected(spark)  # also before each further stage
    return exact_dedup.deduplicated(docs, folder=work_dir(spark, "stage-copies"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 or more between their five-word shingles the one with the smallest identifier stays."""
    cleanup(spark, "stage-copies")  # its stage has been written
    collected(spark)
    return simhash.deduplicated(docs, folder=work_dir(spark, "stage-near-copies"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    cleanup(spark, "stage-near-copies")
    collected(spark)
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows: the pieces of all documents that are left, with their tokens."""
    collected(spark)
    pieces = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return pieces.select("row.doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("language_id", identified), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("decontamination", without_benchmark), ("packing", packed)]

#: The models of the stages are beyond SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in `sf_dir`; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = work_dir(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
