"""What scoring a stream costs: texts are split by a cheap class, hashed once for training, and their words made once for all passes."""

import random

from pyspark.ml.feature import RegexTokenizer
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.operators import model as md
from wordloom.operators import normalize as nm
from wordloom.plans import queries as q


def test_whitespace_run_splits_as_python_does(spark):
    rng = random.Random(3)
    near = [chr(c) for c in (0x84, 0x86, 0x9F, 0xA1, 0x1681, 0x180E, 0x1FFF, 0x200B, 0x2027, 0x202A, 0x2030, 0x2060, 0x3001, 0x0B95, 0x1F600)]
    texts = ["".join(rng.choice([*tx.WHITESPACE_CHARS, *near, *"abc "]) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["a" + " " * 200_000 + "b" + "  " * 100_000 + "c", " ", ""]
    tok = RegexTokenizer(inputCol="text", outputCol="words", pattern=tx.WHITESPACE_RUN, toLowercase=False)
    got = tok.transform(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert all(r.words == r.text.split() for r in got)
    assert md.feature_stages(md.TrainParams())[0].getPattern() == tx.WHITESPACE_RUN


def test_training_reads_its_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    def rows(n):
        return spark.range(n).select(F.pmod("id", F.lit(2)).alias("label_idx"), F.concat(F.lit("word"), F.pmod("id", F.lit(7))).alias("raw"))

    train, val = (rows(n).withColumn("text", seen("raw")).drop("raw") for n in (300, 100))
    sel = md.train_select(spark, train, val, md.TrainParams(max_rounds=2, num_features=64))
    assert read.value == 400
    assert [type(s).__name__ for s in sel.model.stages] == ["RegexTokenizer", "HashingTF", "IDFModel", "LogisticRegressionModel"]


def test_streamed_scoring_makes_the_words_once(spark, tmp_path, monkeypatch):
    words = ["plz", "semma", "superrrrr", "movie", "this", "is", "Gr8", "ok"]
    rng = random.Random(1)
    docs = [(i, None if i == 3 else " ".join(rng.choices(words, k=12)), "en", "s", 1) for i in range(120)]
    docs[5] = (5, " \t ", "en", "s", 3)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 3 % 2, 0) for i in range(0, 120, 2)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    passes, count = [], nm.word_counts
    monkeypatch.setattr(nm, "word_counts", lambda *a, **k: passes.append(1) or count(*a, **k))
    got = q.stream_scored(spark, str(tmp_path)).collect()
    assert sorted(r.row_id for r in got) == [i for i in range(120) if i != 3] and all(r.same for r in got)
    assert len(passes) == 1
