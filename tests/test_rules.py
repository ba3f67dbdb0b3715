"""Each Java-regex rule equals Python's own str / re behaviour."""

import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.functions import text as tx

ALPHABET = (string.ascii_letters + string.digits + "_'!?.,-#@()\"*" + " \t\n\x0b\x0c\r\x1c\x1f\x85\xa0"
            + "  　" + "éÉßçÇ" + "நன்றி" + "ǅǈ" + "🔥" + "́")
words = st.text(alphabet=ALPHABET, min_size=0, max_size=12)


def _eval(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, w string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("w"))).collect()]


@settings(max_examples=5, deadline=None)
@given(st.lists(words, min_size=50, max_size=80))
def test_split_equals_str_split(spark, values):
    got = _eval(spark, values, lambda c: F.filter(tx.split_words(c), lambda x: x != ""))
    assert got == [v.split() for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(words, min_size=50, max_size=80))
def test_clean_word_equals_python_re(spark, values):
    got = _eval(spark, values, tx.clean_word)
    assert got == [re.sub(r"^\W+|\W+$", "", v.lower()) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(words, min_size=50, max_size=80))
def test_case_pattern_equals_str_methods(spark, values):
    def py(v):
        if v.isupper():
            return "upper"
        if v.istitle():
            return "title"
        if v.islower():
            return "lower"
        return "mixed"

    got = _eval(spark, values, tx.case_pattern)
    assert got == [py(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aabbbcé🔥", max_size=12), min_size=50, max_size=80))
def test_destretch_equals_python_re(spark, values):
    got = _eval(spark, values, tx.destretch)
    assert got == [re.sub(r"(.)\1{2,}", r"\1\1", v) for v in values]


def test_similarity_threshold_is_double_formula(spark):
    # length 5, distance 1 -> 0.8 exactly passes; the decimal shortcut would not
    df = spark.createDataFrame([("coool", "cool"), ("abcde", "abcdf"), ("", "x")], "a string, b string")
    got = [r[0] for r in df.select(tx.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [0.8, 0.8, 0.0]


def test_case_pattern_of_very_long_tokens(spark):
    long = ["Ab." * 350_000, "AB" * 500_000, "ab" * 500_000, "aB" * 500_000]
    assert _eval(spark, long, tx.case_pattern) == ["title", "upper", "lower", "mixed"]
