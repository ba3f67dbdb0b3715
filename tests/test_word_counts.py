"""Words counted per Arrow batch, texts rebuilt by batch, the cascade's letter prune, answers shared by the passes of a query."""

import random
from collections import Counter

from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.operators import features as fe
from wordloom.operators import match
from wordloom.operators.normalize import lookup_words, raw_words, text_words, tokenize, vocabulary
from wordloom.plans import queries as q

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def _odd_texts():
    rng, marks = random.Random(5), [c for c in map(chr, range(0x3001)) if c.isspace()]
    parts = ["vdo", "GUD,", "x", "***", "வண", "​", "’s", "\U0001f600", "İI", *marks]
    return [None, "", " ", "　", "a", *("".join(rng.choice(parts) + rng.choice(["", " ", "b"]) for _ in range(40)) for _ in range(300))]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_without_a_row_per_token(spark, tmp_path):
    texts = _odd_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").repartition(3)
    want = Counter(w for t in texts if t for w in t.split() if len(w) >= 2)
    assert {r.word: r.n_tokens for r in text_words(rows).collect()} == want
    by_token = raw_words(tokenize(rows, "text"))
    assert sorted(map(tuple, text_words(rows).collect())) == sorted(map(tuple, by_token.collect()))
    assert sorted(lookup_words(text_words(rows)).collect()) == sorted(vocabulary(tokenize(rows, "text")).collect())
    spark.createDataFrame([(i, t, "en", "src0", 1) for i, t in enumerate(texts)], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("word_map", "stretch_matches", "oov_distinct_count"):
        plan = _plan(q.registry()[name](spark, str(tmp_path)))
        assert "MapInArrow" in plan and "Generate explode(split" not in plan and "posexplode" not in plan, name


def test_vocabulary_is_counted_without_a_row_per_token(spark, monkeypatch):
    texts = [t for t in _odd_texts() if t]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    counted, made = fe.word_counts, []
    monkeypatch.setattr(fe, "word_counts", lambda *a, **k: made.append(counted(*a, **k)) or made[-1])
    got = {r.tok: r.id for r in fe.learn_vocabulary(rows).collect()}
    counts = Counter(r.w for r in rows.select(F.explode(F.split(F.lower(tx.collapse_ws(F.col("text"))), " ")).alias("w")).collect() if r.w)
    assert got == {t: i + fe.FIRST_WORD_ID for i, (t, _) in enumerate(sorted(counts.items(), key=lambda e: (-e[1], e[0].encode())))}
    assert made and "Generate" not in _plan(made[0])


def test_rebuilt_equals_replaced_words(spark, normalizer):
    rng = random.Random(6)
    cases = []
    for t in _odd_texts():
        n = len((t or "").split())
        cases.append((t, [(p, rng.choice(["", "Z", "x y", "வ"])) for p in rng.sample(range(n), rng.randint(0, n))]))
    df = spark.createDataFrame(cases, "t string, c array<struct<pos: int, out_word: string>>").filter("t is not null")
    for r in df.select(tx.replace_words(tx.split_words(F.col("t")), F.col("c")).alias("a"), tx.rebuilt(F.col("t"), F.col("c")).alias("b")).collect():
        assert r.a == r.b
    rows = spark.createDataFrame([(1, "GUD\tvdo"), (2, None)], "row_id long, text string")
    done = normalizer.normalize(rows, "text")
    assert "ArrowEvalPython" in _plan(done)
    assert [tuple(r) for r in done.collect()] == [(1, "GOOD video", "GUD\tvdo")]


def test_letter_prune_is_lossless_and_prunes(spark, dictionary, monkeypatch):
    rng, keys = random.Random(7), [r.key for r in dictionary.df.collect()]
    words = set()
    for key in keys * 6:
        w = list(key)
        for _ in range(rng.randint(0, 3)):
            at, letter = rng.randrange(len(w) + 1), rng.choice("abzo9éவ\U0001f600")
            w[at:at + rng.randint(0, 1)] = rng.choice([[], [letter]])
        words.add("".join(w))
    vocab = spark.createDataFrame([(w,) for w in words if w], "clean string")
    kept = [sorted(map(tuple, match._bucket_candidates(vocab, dictionary, match.MatchParams()).collect()), key=str)]
    assert "bit_count" in _plan(match._bucket_candidates(vocab, dictionary, match.MatchParams()))
    monkeypatch.setattr(match, "letter_mask", lambda c: F.lit(0).cast("bigint"))  # nothing is pruned
    kept.append(sorted(map(tuple, match._bucket_candidates(vocab, dictionary, match.MatchParams()).collect()), key=str))
    assert kept[0] == kept[1] and len(kept[0]) > len(keys)


def test_words_are_counted_once_a_query(spark, tmp_path, monkeypatch):
    docs = [(i, t, "en", "src0", 1) for i, t in enumerate(_odd_texts())]
    spark.createDataFrame(docs, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 3 % 2) for i, *_ in docs], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    asked = []
    for module in ("wordloom.plans.queries", "wordloom.operators.normalize"):
        monkeypatch.setattr(f"{module}.text_words", lambda *a: asked.append(a) or text_words(*a))
    n_words = q.oov_distinct_count(spark, str(tmp_path)).first()[0]
    for name in ("artifact_record", "final_summary", "report_record"):
        asked.clear()
        row = q.registry()[name](spark, str(tmp_path)).first().asDict()
        assert len(asked) == 1, name
        assert row.get("fuzzy_cache_size", row.get("cache_size", n_words)) == n_words
