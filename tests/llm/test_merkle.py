"""The Merkle manifest against plain Python: runs of every length, null and equal rows, one leaf, no leaf."""

import os
import sys
import zlib

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from wordloom.llm import merkle  # noqa: E402

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, tree string, idx string, digest int, path string, key string, at int, pid int, tie int, n int"
EXTRA = (7, "t", "i", 1, "p", "k", 2, 3, 4, 5)


def rows_of(sizes):
    rows = [(i * 7 % 1000 + 1000 * s, name, "en" if i % 3 else None, i, f"text {i}\nof é {s}\n" if i % 4 else f"text {i}") for s, (name, n) in enumerate(sizes) for i in range(n)]
    return rows + [(None, "a", None, None, None), (3, "a", "en", 0, ""), (3, "a", "en", 0, ""), (3, "a", "en", None, "\n"), (9, None, None, 4, "x\ny")]


def tampered(i, text):
    return text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text


def run(spark, rows, arity):
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(5)
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    got = merkle.manifest(docs, arity=arity, tampered={"text": F.translate("text", "\n", "")}, when=even)
    return [tuple(r) for r in merkle.verified(got).collect()]


@pytest.mark.parametrize("arity", [2, 3])
def test_leaves_proofs_and_tampering(spark, arity):
    rows = rows_of([("b", 28), ("é", 9), ("a", 1), ("A", 10), ("z", 1), ("", 4), ("~", 2)])
    got = run(spark, rows, arity)
    assert sorted(got, key=str) == sorted(brute.merkle(rows, arity, tampered), key=str)
    assert {r[-1] for r in got} == {True, False}


def test_one_row_and_no_rows(spark):
    one = [(1, "s", "en", 3, "a\nb")]
    assert run(spark, one, 3) == list(brute.merkle(one, 3, tampered))
    assert run(spark, [], 3) == []


def test_tamper_free_rows_verify(spark):
    docs = spark.createDataFrame(rows_of([("b", 30)]), "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.verified(merkle.manifest(docs)).where("not verified").isEmpty()
