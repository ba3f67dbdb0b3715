"""The end-to-end splits job on CSV splits written from the smallest tables."""

from pyspark.sql import functions as F

from wordloom.jobs.splits import run
from wordloom.operators.normalize import tokenize
from wordloom.operators.stats import normalization_stats
from wordloom.plans import inputs
from wordloom.sources.csv_splits import scratch_folder, write_splits

from conftest import SMALL_SF


def test_splits_job(spark, normalizer):
    lab = inputs.labelled_comments(spark, SMALL_SF).select(
        "split", F.col("row_id").alias("comment_id"), F.col("text").alias("comment"), F.col("label").alias("category"))
    folder = scratch_folder(spark, "job-test")
    paths = write_splits(lab.coalesce(1), f"{folder}/in")
    out = run(spark, paths, f"{folder}/out")

    processed = spark.read.options(
        header="true", multiLine="true", escape='"').csv(out["processed"])
    want = normalizer.normalize(lab.select(F.col("comment_id").alias("row_id"), "comment"), "comment")
    got = sorted((int(r.comment_id), r.comment) for r in processed.collect())
    assert got == sorted((r.row_id, r.comment) for r in want.collect())

    stats = {r.split: r for r in spark.read.parquet(out["normalization_stats"]).collect()}
    exp_toks = tokenize(lab.select(F.col("comment_id").alias("row_id"), "split", F.col("comment").alias("text")),
                        "text", keys=("row_id", "split"))
    exp = {r.split: r for r in normalization_stats(normalizer.annotate(exp_toks)).collect()}
    assert {k: tuple(v) for k, v in stats.items()} == {k: tuple(v) for k, v in exp.items()}

    report = spark.read.json(out["report"]).first()
    assert 0.0 <= report.model_performance.test_accuracy <= 1.0
    assert report.fuzzy_matching.max_edit_distance == 2
    mapping = spark.read.parquet(out["label_mapping"]).collect()
    assert sorted(r.idx for r in mapping) == list(range(len(mapping)))
