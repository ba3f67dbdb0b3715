"""A run is trained in one session and scored in another, as a table and as a stream, with equal records."""

import json
import os
import subprocess
import sys
import tempfile

from pyspark.sql import functions as F

from wordloom.jobs import splits
from wordloom.jobs.score import Scorer
from wordloom.operators import model as md
from wordloom.operators.labels import label_distribution, label_mapping, named_nulls
from wordloom.plans import inputs
from wordloom.sources.csv_splits import scratch_folder, write_splits
from wordloom.sources.dictionary import dictionary_from_mapping, load_dictionary

from conftest import SMALL_SF

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _records(df):
    return sorted((r.row_id, r.original_text, r.processed_text, r.predicted_class, round(r.confidence, 9),
                   json.dumps({k: round(v, 9) for k, v in sorted(r.all_probabilities.items())})) for r in df.collect())


def test_train_here_score_elsewhere(spark):
    folder = scratch_folder(spark, "score-test")
    lab = inputs.labelled_comments(spark, SMALL_SF).select(
        "split", F.col("row_id").alias("row_id"), F.col("text").alias("comment"), F.col("label").alias("category"), F.lit("mine").alias("label2"))
    paths = write_splits(lab.repartition(3), f"{folder}/in")
    run = f"{folder}/run"
    out = splits.run(spark, paths, run, params=md.TrainParams(max_rounds=2, num_features=1 << 12))
    comments = inputs.comments(spark, SMALL_SF).select("row_id", "text")
    comments.write.parquet(f"{folder}/comments")
    here = _records(Scorer.load(spark, run).score(comments))
    assert len(here) == comments.filter("text is not null and trim(translate(text, '\\t\\n', '')) != ''").count()

    # another process, with nothing but the run's folder
    job = [sys.executable, "-m", "wordloom.jobs.score", "--run", run, "--input", f"{folder}/comments"]
    work = tempfile.mkdtemp(prefix="wordloom-score-", dir="/tmp")
    conf = "--conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=4 --master local[2] pyspark-shell"
    env = {**os.environ, "PYTHONPATH": TOP, "PYSPARK_SUBMIT_ARGS": conf}
    subprocess.run([*job, "--out", f"{folder}/scored"], check=True, cwd=work, env=env, capture_output=True)
    assert _records(spark.read.parquet(f"{folder}/scored")) == here

    # the same comments as arriving files
    source = spark.readStream.schema("row_id long, text string").parquet(f"{folder}/comments")
    live = Scorer.load(spark, run).score_stream(spark, source, f"{folder}/live", f"{folder}/live-ckpt")
    assert _records(md.scored_record(spark.read.parquet(live.rows_path), keys=("row_id",))) == here

    # the artifact holds the dictionary in order; the job's outputs hold the user's columns only
    kept = Scorer.load(spark, run).normalizer.dictionary.df.orderBy("ord").select("key", "value").collect()
    assert kept == load_dictionary(spark).df.orderBy("ord").select("key", "value").collect()
    processed = spark.read.options(header="true", multiLine="true", escape='"').csv(out["processed"])
    assert processed.columns == ["row_id", "comment", "category", "label2", "comment_original", "split"]
    profile = {r.split: r for r in spark.read.json(out["split_profile"]).collect()}
    assert profile["train"].column_names[2:] == ["row_id", "comment", "category", "label2"] and len(profile["train"].head) == 2
    assert spark.read.parquet(out["sample_rows"]).count() == 5
    assert spark.read.parquet(out["impact_summary"]).first().words_normalized > 0
    assert spark.read.parquet(out["fuzzy_examples"]).count() == 10


def test_dictionary_given_as_a_mapping(spark):
    from wordloom.operators.normalize import Normalizer

    d = dictionary_from_mapping(spark, {"vdo": "clip", "vdeo": "film", "kewl": "cool"})
    rows = spark.createDataFrame([(1, "Vdo KEWL! vdio")], "row_id long, text string")
    assert Normalizer(d).normalize(rows, "text").first().text.startswith("Clip COOL!")
    assert [r.key for r in d.df.orderBy("ord").collect()] == ["vdo", "vdeo", "kewl"]


def test_missing_labels_as_a_class(spark):
    rows = spark.createDataFrame([(2, "a"), (1, None), (3, "b"), (4, "a")], "row_id long, label string")
    assert {r.label: r.idx for r in label_mapping(rows).collect()} == {"a": 0, "b": 1}
    assert {r.label: r.idx for r in label_mapping(named_nulls(rows)).collect()} == {"nan": 0, "a": 1, "b": 2}
    assert [tuple(r) for r in label_distribution(rows).collect()] == [("a", 2), ("b", 1)]


def test_blank_values_in_a_dictionary(spark):
    """P2 and W3 without normalising are right only if no value is blank; else they normalise."""
    from wordloom.operators import report as rp
    from wordloom.operators.normalize import Normalizer

    rows = spark.createDataFrame([(1, "s", " "), (2, "s", "gone"), (3, "s", "vdo"), (4, "s", None)], "row_id long, split string, text string")
    for mapping, out in (({"vdo": "clip"}, 2), ({"vdo": "clip", "gone": ""}, 1)):
        n = Normalizer(dictionary_from_mapping(spark, mapping))
        assert tuple(n.blank_counts(rows, "split").first()) == ("s", 4, out)
        head = rp.first_texts(rows, n.dictionary, n=1)
        assert n.normalize(head, "text").orderBy("row_id").first().row_id == (2 if out == 2 else 3)
