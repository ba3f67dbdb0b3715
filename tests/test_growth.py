"""What grows with the input: regexes per distinct word, gradients per core, micro-batches per byte."""

import glob
import random

from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.operators import model as md
from wordloom.operators.normalize import raw_words, tokenize, vocabulary
from wordloom.plans import queries as q

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_words_are_cleaned_after_the_distinct(spark, normalizer):
    toks = tokenize(spark.createDataFrame([(1, "Gud, gud!! x")], "row_id long, text string"), "text")
    for words in (vocabulary(toks), normalizer._candidates(raw_words(toks))):
        plan = words._jdf.queryExecution().optimizedPlan().toString()
        assert "lower(word" in plan and "lower(word" not in plan[plan.rindex("Aggregate ["):]
    assert [r.clean for r in vocabulary(toks).collect()] == ["gud"]


def test_whitespace_is_pythons(spark):
    rng, marks = random.Random(3), [c for c in map(chr, range(0x3001)) if c.isspace()]
    texts = ["", None, "a", " ", "\u3000", *marks, *(f"a{c}b" for c in marks)]
    texts += ["".join(rng.choice([*"ab,\u0bb5\u200b\U0001f600", *rng.sample(marks, 2)]) for _ in range(30)) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.col("t")
    for r in rows.select("t", tx.split_words(t).alias("w"), tx.collapse_ws(t).alias("c"), tx.strip_ws(t).alias("s"), tx.is_blank(t).alias("b")).collect():
        if r.t is None:
            assert (r.w, r.c, r.s, r.b) == (None, None, None, True)
        else:
            assert (r.w, r.c, r.s, r.b) == (r.t.split() or [""], " ".join(r.t.split()), r.t.strip(), not r.t.strip())


def test_optimizer_steps_send_a_gradient_a_core(spark, monkeypatch):
    rows = spark.createDataFrame([(f"w{i % 7} v{i % 3}", i % 2) for i in range(200)], "text string, label_idx int").repartition(40)
    seen, make = [], md.classifier

    class Seen:
        def __init__(self, *args):
            self.real = make(*args)

        def fit(self, df):
            seen.append(df.rdd.getNumPartitions())
            assert df.count() == 200
            return self.real.fit(df)

    monkeypatch.setattr(md, "classifier", Seen)
    md.train_select(spark, rows, rows, md.TrainParams(max_rounds=2, num_features=64))
    assert seen and max(seen) <= spark.sparkContext.defaultParallelism


def test_small_files_share_a_micro_batch(spark, tmp_path):
    rows = [(i, f"Gud vdo {i}", "en", "src0", 10) for i in range(60)]
    spark.createDataFrame(rows, DOCUMENTS).repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    out, _ = q._run_comment_stream(spark, str(tmp_path))
    assert len(glob.glob(f"{out.rows_path.removeprefix('file:')}/batch_id=*")) == 1
    stream = spark.read.parquet(out.rows_path).select("row_id", "text", "text_original")
    batch = q.preprocess_documents(spark, str(tmp_path)).select("row_id", "text", "text_original")
    assert sorted(stream.collect()) == sorted(batch.collect()) and stream.count() >= 60
