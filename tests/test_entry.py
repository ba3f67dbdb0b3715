"""Driver contract: entry, queries, oracle keys; streams give the batch answer."""

import __spark_entry__ as entry
from wordloom.plans.queries import registry

from conftest import SMALL_SF


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["row_id", "split", "text", "lang", "source", "text_original"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark):
    q = registry()
    batch = sorted(tuple(r) for r in q["preprocess_documents"](spark, SMALL_SF).collect())
    stream = sorted(tuple(r) for r in q["stream_normalized"](spark, SMALL_SF).collect())
    assert batch == stream
    s1 = sorted(tuple(r) for r in q["normalization_stats"](spark, SMALL_SF).collect())
    s2 = sorted(tuple(r) for r in q["stream_stats"](spark, SMALL_SF).select(
        "split", "exact_matches", "fuzzy_matches", "stretch_matches", "no_matches", "total_words").collect())
    assert s1 == s2


def test_model_queries_run(spark):
    q = registry()
    hist = q["model_selection"](spark, SMALL_SF).collect()
    assert 1 <= len(hist) <= 15 and sum(r.best for r in hist) == 1
    scored = q["scored_comments"](spark, SMALL_SF).collect()
    assert scored and all(abs(sum(r.all_probabilities.values()) - 1.0) < 1e-9 for r in scored)
    assert all(r.confidence == max(r.all_probabilities.values()) for r in scored)
    assert all(r.same for r in q["model_roundtrip"](spark, SMALL_SF).collect())
