"""Alignment of two tokenizers against plain Python over the libraries' own output."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path

from wordloom.llm import alignment

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, id int, a int, b int, c int, pair string, first int, unit string, sha string, at int"
EXTRA = (1, 2, 3, 4, "p", 5, "u", "s", 6)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "Thnd", "eréa", "ation", "über", "x1", "ing,", "don't", "naïve", "日本", "🔥", "Tokenizers"]) for _ in range(n))


TEXTS = [
    (1, prose(1, 200)), (2, prose(1, 200)), (3, None), (4, ""), (5, " "), (6, "  two  spaces \n\t and tabs  "), (7, "a<|endoftext|>b <s> </s> <unk> <0x41>"), (8, "lower ▁ line"),
    (9, "é ligature ﬁ ½   x​x"), (10, "x"), (11, prose(2, 3000)), (None, prose(3, 50)), (None, "the the the"), (12, "\x00\x01 nul"), (12, "\x85 next line"), (13, "y" * 3000),
    (14, "  leading"), (15, "trailing "), (16, "\U0001F9FF\U0001FAE0 new"), (17, "it's we'll 'S I'd  'm"),
]


def plain(rows, a, b):
    """Rows of the definition, with tokens' bytes taken from the libraries one text at a time."""
    def tokens(library, text):
        return [(i, library.tokens[i]) for i in library.encode([text])[0]]

    docs = []
    for i, text in rows:
        ta = [(x, a.tokens[x]) for x in a._library([" " + text])[0]] if text else []
        tb = tokens(b, text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(x for _, x in ta) != whole or b"".join(x for _, x in tb) != whole:
            ta, tb = [], []
        ends = [np.cumsum([len(x) for _, x in t]).tolist() for t in (ta, tb)]
        links = [(x, y) for (x, _), e in zip(ta, ends[0], strict=True) for (y, _), f in zip(tb, ends[1], strict=True) if e == f] if len(ta) < 600 else \
            [(ta[ends[0].index(e)][0], tb[ends[1].index(e)][0]) for e in sorted(set(ends[0]) & set(ends[1]))]
        cuts, groups, low = sorted(set(ends[0]) & set(ends[1])), [], 0
        for cut in cuts:
            sides = [",".join(str(x) for (x, _), e in zip(t, es, strict=True) if low < e <= cut) for t, es in ((ta, ends[0]), (tb, ends[1]))]
            groups.append("|".join(sides))
            low = cut
        docs.append((i, ta, tb, groups, links))
    count = Counter(p for *_, links in docs for p in links)
    most = {}
    for (_, y), c in count.items():
        most[y] = max(most.get(y, 0), c)
    for i, ta, tb, groups, links in docs:
        yield (i, len(ta), len(tb), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links),
               hashlib.sha256(";".join(groups).encode()).hexdigest() if ta else "")


def test_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, *EXTRA) for r in TEXTS], SCHEMA).repartition(3)
    got = [tuple(r) for r in alignment.align(docs, A, B).collect()]
    expected = list(plain(TEXTS, alignment.BytePairs(A), alignment.Pieces(B)))
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert sum(r[1] > 0 for r in expected) > 10 and sum(r[1] == 0 for r in expected) >= 3
    empty = alignment.align(docs.limit(0), A, B)
    assert empty.count() == 0


def test_slices_of_units_are_slices_of_texts(monkeypatch):
    import pyarrow as pa

    pair = alignment.pair_of(A, B)
    texts = [t for _, t in TEXTS if t]
    rows = pa.RecordBatch.from_pydict({"id": list(range(len(texts)))})
    whole = alignment._block(rows, pa.array(texts), pair)
    for size in (50, 400):
        monkeypatch.setattr(alignment, "UNIT_CHARS", size)
        cut = alignment._block(rows, pa.array(texts), pair)
        for c in ("id", "n_a", "n_b", "n_groups", "n_links", "sha"):
            assert cut[c].to_pylist() == whole[c].to_pylist(), c
        pairs = [{(a, b): c for a, b, c in zip(*(x[n].to_pylist()[0] for n in "abc"), strict=True)} for x in (whole, cut)]
        assert pairs[0] == pairs[1]


@pytest.mark.parametrize("size", [40, 1000])
def test_units_give_the_text_back(size):
    for _, text in TEXTS:
        if text:
            got = list(alignment.units(text, size))
            assert "".join(got) == " " + text and all(u.startswith(" ") for u in got)


def test_the_fast_library_splits_as_the_given_one():
    a = alignment.BytePairs(A)
    assert a.fast is not None
    rng = random.Random(5)
    settled = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2028))]
    texts = ["".join(rng.choices(settled, k=60)) for _ in range(300)] + [t or "" for _, t in TEXTS]
    assert a.encode(texts) == a._library(texts)


def test_linked_pairs_are_bounded_by_the_vocabularies(spark):
    pair = alignment.pair_of(A, B)
    assert alignment.pair_bound(pair) < 400_000
    slices = alignment.blocks(spark.createDataFrame(TEXTS, "doc_id long, text string"), A, B)
    for a, b, _, _ in alignment.pair_counts(slices).collect():
        x, y = pair.a.tokens[a], pair.b.tokens[b]
        assert x.endswith(y) or y.endswith(x)
