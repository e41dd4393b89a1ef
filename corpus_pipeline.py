"""Corpus pipeline over ``documents``.

Stages, each on everything its predecessor kept: documents of low quality
go; documents without a clear language go; one document of each group of
near duplicates stays; documents that hold a benchmark item go; the rest is
packed into sequences.  All but the last return the columns of documents;
the last returns one row per packed piece (doc_id, start, length,
doc_tokens, sequence_id, offset, ids_crc32).

Rows without a doc_id pass the stages that decide by document (duplicates,
benchmark); null and empty texts are rejected with their language.  Without
labelled training rows every quality score is 0.5, so that stage keeps all;
an empty table gives no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlane.llm import common, decontam, langid, minhash, packing, quality
from fleetlane.sources.files import delete
from fleetlane.sources.tables import table

TOKENIZER = "byte_bpe_50k.json"  # of the public vocabulary files


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Factorisation machine fitted on the labelled training folds of
    ``docs``; scores of at least 0.3 stay."""
    common.prepare(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is not a near tie stay."""
    common.prepare(spark)
    return langid.keep_known(docs, langid.train(docs), min_score=0.25)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles,
    similarity 0.8 or more): the one with the smallest doc_id."""
    common.prepare(spark)
    return minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover no benchmark item by half stay."""
    common.prepare(spark)
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents in sequences of 1024 tokens."""
    import public_tokenizers
    common.prepare(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), carry={"ids_crc32": F.crc32("ids")})


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_dedup", dedup_stage),
          ("decontamination", decontamination_stage), ("packing", packing_stage)]

# Learnt models and token ids cannot be written in SQL; tests/llm compares
# with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; every result is written as Parquet under
    the shared checkpoint folder, read again by the next stage, and deleted
    when that stage's result is written."""
    common.prepare(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = common.scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
