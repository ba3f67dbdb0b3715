"""The paths taken beyond the broadcast bounds give the same answers."""

import dataclasses

from wordloom.operators.match import word_map
from wordloom.operators.normalize import Normalizer, tokenize
from wordloom.plans import inputs

from conftest import SMALL_SF


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_salted_word_map_join_equals_broadcast(spark, normalizer):
    comments = inputs.comments(spark, SMALL_SF)
    want = _rows(normalizer.normalize(comments, "text"))
    salted = dataclasses.replace(normalizer, broadcast_rows=0, salt_buckets=7)
    assert _rows(salted.normalize(comments, "text")) == want


def test_shuffle_dictionary_joins_equal_broadcast(spark, dictionary, monkeypatch):
    import wordloom.operators.match as match_mod
    import wordloom.sources.dictionary as dict_mod

    comments = inputs.comments(spark, SMALL_SF)
    want = _rows(Normalizer(dictionary).normalize(comments, "text"))
    monkeypatch.setattr(dict_mod, "MAX_BROADCAST_ROWS", 0)
    monkeypatch.setattr(match_mod, "MAX_BROADCAST_ROWS", 0)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    saved = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")  # no size-based broadcast either: real shuffle joins
    try:
        plain = Normalizer(dictionary)
        vocab_plan = plain.word_map(tokenize(comments, "text"))
        assert "BroadcastHashJoin" not in vocab_plan._jdf.queryExecution().executedPlan().toString()
        got = _rows(plain.normalize(comments, "text"))
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert got == want
    vocab = spark.createDataFrame([(w,) for w in ["vdo", "voulda", "nallllla", "thankyou", "zzz"]], "clean string")
    a = _rows(word_map(vocab, dictionary, strategy="bucket").select("clean", "stage", "match_key"))
    b = _rows(word_map(vocab, dictionary, strategy="deletion").select("clean", "stage", "match_key"))
    assert a == b == [("nallllla", "stretch", "nalla"), ("thankyou", "fuzzy", "thank you"),
                      ("vdo", "exact", "vdo"), ("voulda", "fuzzy", "coulda")]
