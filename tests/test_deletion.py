"""Deletion-neighbourhood candidates are lossless: every pair that can pass the
fuzzy gate shares a variant generated within both sides' deletion budgets."""

import random

from pyspark.sql import functions as F

from wordloom.operators.match import MatchParams, deletion_budget, deletion_variants

from distance import distance


def _pairs(n=3000, seed=13):
    rnd = random.Random(seed)
    alphabet = "abcde"
    out = []
    while len(out) < n:
        a = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 12)))
        b = list(a)
        for _ in range(rnd.randint(0, 3)):
            op, pos = rnd.randint(0, 2), rnd.randint(0, max(len(b) - 1, 0))
            if op == 0 and b:
                b[pos] = rnd.choice(alphabet)
            elif op == 1:
                b.insert(pos, rnd.choice(alphabet))
            elif len(b) > 1:
                del b[pos]
        out.append((a, "".join(b)))
    return out


def test_variants_cover_every_passing_pair(spark):
    p = MatchParams()
    pairs = _pairs()
    df = spark.createDataFrame(pairs, "a string, b string")
    k = p.fuzzy_threshold
    got = df.select(
        "a", "b",
        deletion_variants(F.col("a"), deletion_budget(F.length("a"), p), k).alias("va"),
        deletion_variants(F.col("b"), deletion_budget(F.length("b"), p), k).alias("vb"),
    ).collect()
    checked = 0
    for r in got:
        d = distance(r.a, r.b)
        sim = 1 - d / max(len(r.a), len(r.b), 1)
        if d <= k and sim >= p.levenshtein_threshold and sim > 0:
            checked += 1
            assert set(r.va) & set(r.vb), (r.a, r.b)
    assert checked > 200
