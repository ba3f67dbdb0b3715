"""The lookup cascade against a brute-force plain-Python model."""

import random
import re

from pyspark.sql import functions as F

from wordloom.operators.match import word_map, word_map_staged
from wordloom.sources.dictionary import CUSTOM_TABLE, DEFAULT_TABLE, read_fixed_table



def _table():
    table = {}
    for p in (DEFAULT_TABLE, CUSTOM_TABLE):
        for k, v in read_fixed_table(p):
            table[k] = v
    return table


def _damaged_words(keys, n=3000, seed=7):
    rnd = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzé"
    out = set()
    while len(out) < n:
        w = list(rnd.choice(keys).replace(" ", rnd.choice(["", " "])))
        for _ in range(rnd.randint(0, 3)):
            op = rnd.randint(0, 3)
            pos = rnd.randint(0, max(len(w) - 1, 0))
            if op == 0 and w:
                w[pos] = rnd.choice(letters)
            elif op == 1:
                w.insert(pos, rnd.choice(letters))
            elif op == 2 and len(w) > 1:
                del w[pos]
            elif w:
                w[pos:pos + 1] = [w[pos]] * rnd.randint(3, 6)
        word = "".join(w).strip()
        if word and " " not in word:
            out.add(word)
    return sorted(out)


def test_word_map_matches_sql(spark, dictionary):
    import duckdb
    import pandas as pd

    keys = pd.DataFrame({"k": list(_table())}).reset_index(names="ord")
    words = _damaged_words(keys["k"].tolist())
    # DuckDB counts bytes; keys are ASCII, so any other character is as far from them as chr(1)
    asked = pd.DataFrame({"w": words, "bytes": [re.sub(r"[^\x00-\x7f]", "\x01", w) for w in words], "short": [re.sub(r"(.)\1{2,}", r"\1\1", w) for w in words]})  # noqa: F841
    expected = duckdb.sql("""
        with near as (select w, k, ord, 1 - levenshtein(bytes, k)::double / greatest(length(bytes), length(k)) as s from asked, keys where levenshtein(bytes, k) <= 2),
        best as (select w, arg_max(k, (s, -ord)) as k from near where s >= 0.8::double group by w)
        select asked.w, case when e.k is not null then 'exact' when best.k is not null then 'fuzzy' when t.k is not null then 'stretch' else 'none' end as stage,
               coalesce(e.k, best.k, t.k) as k
        from asked left join keys e on e.k = asked.w left join best on best.w = asked.w
             left join keys t on t.k = asked.short and asked.short <> asked.w and length(asked.w) >= 3""").fetchall()
    vocab = spark.createDataFrame([(w,) for w in words], "clean string")
    got = {r.clean: (r.stage, r.match_key) for r in word_map(vocab, dictionary).collect()}
    assert {w: got.get(w, ("none", None)) for w in words} == {w: (stage, k) for w, stage, k in expected}
    assert {stage for _, stage, _ in expected} == {"exact", "fuzzy", "stretch", "none"}


def test_deletion_strategy_equals_bucket_strategy(spark, dictionary):
    words = _damaged_words(list(_table()), n=1500, seed=5) + ["thankyou", "veralevel", "mind-blowing", "a", "ab"]
    vocab = spark.createDataFrame([(w,) for w in words], "clean string")
    cols = ["clean", "stage", "match_key", "similarity"]
    a = sorted(tuple(r) for r in word_map(vocab, dictionary, strategy="bucket").select(cols).collect())
    b = sorted(tuple(r) for r in word_map(vocab, dictionary, strategy="deletion").select(cols).collect())
    assert a == b


def test_deletion_variants(spark):
    from wordloom.operators.match import deletion_variants

    df = spark.createDataFrame([("abc",), ("aab",)], "s string")
    got = [sorted(r[0]) for r in df.select(deletion_variants(F.col("s"), F.lit(2), 2)).collect()]
    assert got[0] == sorted({"abc", "bc", "ac", "ab", "a", "b", "c"})
    assert got[1] == sorted({"aab", "ab", "aa", "a", "b"})


def test_single_pass_equals_staged_form(spark, dictionary):
    words = _damaged_words(list(_table()), n=800, seed=11)
    vocab = spark.createDataFrame([(w,) for w in words], "clean string")
    cols = ["clean", "stage", "match_key", "value", "similarity"]
    a = sorted(tuple(r) for r in word_map(vocab, dictionary).select(cols).collect())
    b = sorted(tuple(r) for r in word_map_staged(vocab, dictionary).select(cols).collect())
    assert a == b


def test_dictionary_merge_facts(dictionary):
    d = {r.key: (r.ord, r.value) for r in dictionary.df.collect()}
    assert len(d) == 192
    assert d["adipoli"][1] == "excellent"           # later entry wins
    assert d["adipoli"][0] < d["youtuber"][0]        # first position kept
    assert d["vera level"][1] == "very good"
