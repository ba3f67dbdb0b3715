"""Fingerprints, edited texts and near copies against plain Python."""

import hashlib
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from wordloom.llm import common as cm  # noqa: E402
from wordloom.llm import fingerprints as fps  # noqa: E402

SCHEMA = "doc_id long, text string, id int, node string, mark int, tie int, fp string, n int, head string, pid int, class_id int"
EXTRA = (1, "n", 2, 3, "f", 4, "h", 5, 6)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "eréa", "ation", "über", "🔥x"]) + str(rng.randrange(40)) for _ in range(n))


def varied(text, seed, changes):
    words, rng = text.split(), random.Random(seed)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


BASE = prose(1, 400)
TEXTS = [(i, prose(i, 5 + 7 * i)) for i in range(20, 50)] + [(100 + i, varied(BASE, i, 4)) for i in range(12)] + [
    (1, BASE), (2, None), (3, ""), (4, " \n"), (5, "one"), (6, "One"), (7, "two words"), (8, prose(8, 20_000)), (9, BASE), (10, BASE.upper()),
]


def signature(text, p):
    """By the definition, in plain integers, over the operator's own shingle hashes."""
    import pyarrow as pa

    grams, _ = fps.minhash.shingles(cm.words_of(pa.array([text or ""], pa.large_string()), cm.SPACED, True), p.shingle)
    a, b = fps.permutations(p.places)
    if not len(grams):
        return [0xFFFF] * p.places
    return [int(cm.mix(np.array([min((int(g) * int(x) + int(y)) % 2**64 for g in grams)], np.uint64))[0]) >> 48 for x, y in zip(a, b, strict=True)]


def as_hex(places):
    return np.array(places, "<u2").tobytes().hex()


def expected(rows, p):
    rows = sorted(rows, key=lambda r: -r[0])
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, after = signature(text, p), signature(edited, p), signature(following, p)
        like = lambda x, own=own: sum(u == v for u, v in zip(own, x, strict=True)) / p.places
        yield i, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_hex(own), as_hex(other), like(other), like(after)


def plain(rows):
    return [(r.doc_id, r.n_chars, r.edited_sha256, bytes(r.fp).hex(), bytes(r.edited_fp).hex(), r.near_edited, r.near_next) for r in rows]


@pytest.mark.parametrize("partitions", [1, 8])
def test_rows_and_classes(spark, partitions):
    p = fps.Prints()
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame([(*r, *EXTRA) for r in TEXTS], SCHEMA).repartition(3)
        rows = fps.with_classes(docs).collect()
        assert fps.with_classes(docs.limit(0)).count() == 0
        one = plain(fps.with_classes(docs.where("doc_id = 25")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert sorted(plain(rows)) == sorted(expected(TEXTS, p))
    assert one == list(expected([t for t in TEXTS if t[0] == 25], p))
    group, _ = brute.groups(TEXTS, p.shingle, p.percent)
    least = {g: min(i for (i, _), h in zip(TEXTS, group, strict=True) if h == g) for g in set(group)}
    assert {r.doc_id: r.class_id for r in rows} == {i: i if g is None else least[g] for (i, _), g in zip(TEXTS, group, strict=True)}
    assert len(set(group)) < len(group) - 10


def test_equal_ids_and_null_ids(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "x y z w v u"), (None, "x y z w v u"), (2, "d e f")]
    got = fps.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    edits = sorted(r.edited_sha256 for r in got)
    order = [rows[4], rows[0], rows[1], rows[2], rows[3]]
    made = [fps.edit(a, b) for (_, a), (_, b) in zip(order, order[1:] + order[:1], strict=True)]
    assert edits == sorted(hashlib.sha256(t.encode()).hexdigest() for t in made)


def test_likeness_estimates_the_jaccard_similarity():
    p, rng = fps.Prints(), np.random.default_rng(3)
    off = []
    for share in (0.0, 0.3, 0.6, 0.8, 0.95):
        for _ in range(20):
            common = int(1000 * share)
            sets = [rng.integers(0, 2**63, 1000).astype(np.uint64) for _ in range(2)]
            sets[1][:common] = sets[0][:common]
            jaccard = common / (2000 - common)
            s = fps.signatures(np.concatenate([np.sort(x) for x in sets]), np.array([0, 1000, 2000]), p.places)
            off.append(fps.likeness(s[:1], s[1:])[0] - jaccard)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.07


def test_bands_find_near_copies_at_the_threshold():
    """Share of pairs of similarity 0.8 that share no band: 2e-4 in theory."""
    p, rng = fps.Prints(), np.random.default_rng(4)
    n, common = 1500, 800  # 800 of 1000 elements of the union
    sets = rng.integers(0, 2**63, (n, 1000)).astype(np.uint64)
    a, b = sets[:, :900], np.concatenate([sets[:, :common], sets[:, 900:]], axis=1)
    both = [fps.signatures(x.ravel(), np.arange(n + 1) * 900, p.places).reshape(n, p.bands, p.rows) for x in (a, b)]
    missed = ~(both[0] == both[1]).all(axis=2).any(axis=1)
    assert missed.sum() <= 4
