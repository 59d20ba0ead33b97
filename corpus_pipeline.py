"""The corpus pipeline: five stages over ``documents``, each one of the
training-data operators. A stage works on all that the one before kept; all but
the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry import session
from quarry.llm import bpe, common, decontam, jaccard, langid, suffix_dedup

STAGES = [
    ("language_id", langid.pipeline_stage),
    ("ngram_jaccard_join", jaccard.pipeline_stage),
    ("suffix_array_dedup", suffix_dedup.pipeline_stage),
    ("benchmark_decontamination", decontam.pipeline_stage),
    ("bpe_encoding", bpe.pipeline_stage),
]

# Ranked profiles, chosen paths and merges by rank are not expressible in SQL:
# the stages are tested against brute force (tests/llm).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage keeps is written once to the checkpoint
    folder and read back, as the next one reads it more than once. Tables that a
    stage made for itself, and its input, go as soon as its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with session.scratch(spark) as keep:
            done = common.staged(stage(spark, docs, sf_dir))
            keep(done)
        session.drop_written(spark, docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
