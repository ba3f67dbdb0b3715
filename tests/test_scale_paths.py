"""Full vocabulary, hostile tokens, repeated ids, planning without jobs, dictionaries from a zip or several files."""

import dataclasses
import os
import subprocess
import sys
import tempfile
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordloom.operators import features as fe
from wordloom.operators.layout import spread_by
from wordloom.operators.match import word_map
from wordloom.plans import inputs
from wordloom.sources.dictionary import load_dictionary

from conftest import SMALL_SF

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_vocabulary_holds_every_token_in_order(spark):
    texts = [(i, f"w{i % 97} w{i % 31} common {'x' * (i % 7 + 1)}") for i in range(3000)]
    vocab = fe.learn_vocabulary(spark.createDataFrame(texts, "row_id long, text string"))
    counts = Counter(t for _, text in texts for t in text.split())
    want = {t: i + fe.FIRST_WORD_ID for i, (t, _) in enumerate(sorted(counts.items(), key=lambda e: (-e[1], e[0])))}
    assert {r.tok: r.id for r in vocab.collect()} == want
    empty = fe.learn_vocabulary(spark.createDataFrame([], "row_id long, text string"))
    assert empty.collect() == []


def test_encoding_is_the_same_beyond_the_broadcast_part(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a b c a"), (2, "c unseen a unseen"), (3, ""), (4, None)], "row_id long, text string")
    vocab = fe.learn_vocabulary(rows.filter("row_id = 1"))
    params = fe.EncoderParams(max_length=8)
    want = sorted(map(tuple, fe.encode(rows, vocab, params).collect()))
    monkeypatch.setattr(fe, "HEAD_WORDS", 1)
    assert sorted(map(tuple, fe.encode(rows, vocab, params).collect())) == want
    assert want[1][1] == [0, 6, 3, 4, 3, 2, 1, 1]


def test_every_document_keeps_its_text(spark):
    docs = {r.doc_id: r.text for r in inputs.table(spark, SMALL_SF, "documents").collect()}
    rows = {r.row_id: r.text for r in inputs.comments(spark, SMALL_SF).collect()}
    assert all(rows[i].startswith(t) for i, t in docs.items())
    assert {i for i in rows if i < 0} == {-1 - i for i in docs if i % 50 in (7, 8)}


def test_repeated_row_id_raises(spark, normalizer):
    rows = spark.createDataFrame([(1, "vdo one"), (1, "two vdo"), (2, "three")], "row_id long, text string")
    with pytest.raises(Exception, match="repeated row_id"):
        normalizer.normalize(rows, "text").collect()


def test_long_tokens(spark, dictionary, normalizer):
    words = ["a" * 1_000_000, "ab" * 200_000, "voulda"]
    vocab = spark.createDataFrame([(w,) for w in words], "clean string")
    got = [[tuple(r) for r in word_map(vocab, dictionary, strategy=s).select("clean", "match_key").collect()]
           for s in ("bucket", "deletion")]
    assert got[0] == got[1] == [("voulda", "coulda")]
    rows = spark.createDataFrame([(1, " ".join(words) + " " + "Ab." * 300_000)], "id long, text string")
    out = normalizer.normalize(rows, "text", row_id="id").first().text
    assert out.split()[2:4] == ["could", "have"] and len(out.split()) == 5


def test_salted_join_takes_the_given_row_key(spark, normalizer):
    rows = inputs.comments(spark, SMALL_SF).select(F.col("row_id").alias("id"), "text")
    salted = dataclasses.replace(normalizer, broadcast_rows=0, salt_buckets=5).normalize(rows, "text", row_id="id")
    assert "xxhash64(id" in salted._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(salted.collect()) == sorted(normalizer.normalize(rows, "text", row_id="id").collect())


def test_spreading_runs_no_job(spark):
    joined = inputs.labelled_comments(spark, SMALL_SF)
    tracker, group = spark.sparkContext.statusTracker(), "spread-probe"
    spark.sparkContext.setJobGroup(group, group)
    try:
        spread_by(joined.groupBy("row_id").agg(F.max("text").alias("text")), "row_id")
        assert list(tracker.getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_packaged_tables_load_from_a_zip():
    path = os.path.join(tempfile.mkdtemp(prefix="wordloom-zip-", dir="/tmp"), "lib.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(TOP, "wordloom")):
            for n in names:
                if not n.endswith(".pyc"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, TOP))
    code = ("from wordloom.sources.dictionary import DEFAULT_TABLE, read_fixed_table; "
            "import wordloom; assert 'lib.zip' in wordloom.__file__; print(len(read_fixed_table(DEFAULT_TABLE)))")
    out = subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONPATH": path}, cwd="/tmp",
                         capture_output=True, text=True, check=True)
    assert int(out.stdout) > 100


def test_user_tables_are_read_anew_and_need_an_order(spark):
    folder = tempfile.mkdtemp(prefix="wordloom-dict-", dir="/tmp")
    table = os.path.join(folder, "a.csv")

    def value_of(word):
        return load_dictionary(spark, extra_paths=(table,)).df.filter(F.col("key") == word).first()["value"]

    for value in ("first", "second"):
        with open(table, "w", encoding="utf-8") as fh:
            fh.write(f"key,value\nzzword,{value}\n")
        assert value_of("zzword") == value
    with open(os.path.join(folder, "b.csv"), "w", encoding="utf-8") as fh:
        fh.write("key,value\nother,x\n")
    with pytest.raises(ValueError, match="line"):
        load_dictionary(spark, extra_paths=(folder,))
