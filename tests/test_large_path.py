"""Normalising beyond the broadcast gate: same results, texts never shuffled by word, rebuilding linear in the changes."""

import dataclasses
import re
import time

from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.operators.normalize import tokenize
from wordloom.operators.wordfilter import word_filter
from wordloom.plans import inputs

from conftest import SMALL_SF


def _rows(df):
    return sorted(map(str, df.collect()))


def test_large_path_equals_broadcast_path(spark, normalizer):
    large = dataclasses.replace(normalizer, broadcast_rows=0, salt_buckets=5)
    comments = inputs.comments(spark, SMALL_SF)
    assert _rows(large.normalize(comments, "text")) == _rows(normalizer.normalize(comments, "text"))
    toks = tokenize(comments, "text", keys=("row_id", "split"))
    assert _rows(large.annotate(toks)) == _rows(normalizer.annotate(toks))


def test_texts_never_cross_a_word_keyed_exchange(spark, normalizer):
    large = dataclasses.replace(normalizer, broadcast_rows=0)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        plan = large.normalize(inputs.comments(spark, SMALL_SF), "text")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in keys:
            spark.conf.unset(k)
    lines = plan.split("\n")
    by_word = [i for i, line in enumerate(lines) if re.search(r"Exchange hashpartitioning\(word#", line)]
    assert by_word, plan
    for i in by_word:  # what enters the exchange is the projection right below it
        below = next(line for line in lines[i + 1:] if "Project [" in line)
        assert "text#" not in below and "_carry" not in below, below
    assert "BroadcastHashJoin" in plan  # the word filter


def test_word_filter_passes_every_word(spark):
    words = spark.range(20_000).select(F.concat(F.lit("w"), F.col("id")).alias("word"))
    keep = word_filter(words, 20_000)
    assert keep.keep(words).count() == 20_000
    others = spark.range(50_000).select(F.concat(F.lit("other"), F.col("id")).alias("word"))
    assert keep.keep(others).count() < 50_000 * 0.06
    tiny = word_filter(words, 20_000, max_bits=64 * 512)  # too small for its words: still lossless
    assert tiny.keep(words).count() == 20_000
    assert tiny.rows.count() * 512 == tiny.n_cells


def test_replace_words(spark):
    cases = [(["a", "b", "c"], []), (["a", "b", "c"], [(2, "Z"), (0, "x y")]), (["a"], [(0, "q")]), (["a", "b"], [(1, "")]), (["a", "b", "c", "d"], [(1, "1"), (2, "2")])]
    df = spark.createDataFrame(cases, "w array<string>, c array<struct<pos: int, out_word: string>>")
    got = [r[0] for r in df.select(tx.replace_words(F.col("w"), F.col("c"))).collect()]
    assert got == ["a b c", "x y b Z", "q", "a ", "a 1 2 d"]


def test_rebuilding_is_linear(spark, normalizer):
    """A text of 40,000 hits is rebuilt within about twice the time of one without (and not in the square of its hits)."""
    def seconds(word):
        rows = spark.createDataFrame([(i, " ".join([word, "plain"] * 40_000)) for i in range(4)], "row_id long, text string").repartition(4)
        forms = normalizer.materialize(normalizer.word_forms(tokenize(rows, "text")))
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            out = normalizer.normalize(rows, "text", forms=forms).collect()
            best = min(best, time.perf_counter() - began)
        assert len(out) == 4 and len(out[0].text.split()) == 80_000
        return best

    without, with_hits = seconds("plainly"), seconds("vdo")
    assert with_hits < 2 * without + 1, (with_hits, without)
