"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns documents with the same columns (the last one the
shards' contents, read back).  ``run`` writes every stage's result as Parquet beside the checkpoints and
reads it again, so a stage that fails is repeated alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import common as cm
from wordloom.llm import decontam, langid, minhash, mixing, tokenids
from wordloom.llm.queries import held_out, written_and_read


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents in no learned language (no letter, or byte pairs that suit none that the network holds possible) go."""
    return langid.accepted(docs, langid.train(docs.where(~held_out()), langid.NetParams(least_steps=400)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near-duplicates stays (five-word shingles, similarity 0.8)."""
    return minhash.one_of_each(docs, minhash.NearDup(shingle=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents with a window of a benchmark item go."""
    return decontam.clean(docs, cm.table(spark, sf_dir, "benchmark"), 10)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: sources flattened to 0.9 of the greatest entropy; the largest is read once, the others as often as their budgets say."""
    return mixing.mixed(docs, mixing.Mix()).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: written as token ids and read back through the index."""
    return written_and_read(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token_ids", token_ids),
]

# A network is trained on the way, so no SQL gives these rows; tests/llm holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cm.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = tokenids.fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
