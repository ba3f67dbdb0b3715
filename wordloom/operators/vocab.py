"""Vocabulary report (A3, A4, W2, W2b): word counts over texts, frequent words
outside the dictionary, and the two "top 20" lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.operators.layout import spread_by
from wordloom.sources.dictionary import Dictionary


def word_frequency(texts: DataFrame, text_col: str = "text", row_id: str = "row_id") -> DataFrame:
    """A3: ``lower().split()``, clean, keep length >= 2, count; with first appearance.

    Two hash aggregates: per raw (lower-cased) token, then per cleaned word.
    Partial counts happen before each shuffle, so a hot word costs one row per
    task, and the cleaning regex runs once per distinct token; counts add up
    and first appearances take the minimum of minima.
    """
    toks = (
        spread_by(texts.filter(F.col(text_col).isNotNull()), row_id)
        .select(row_id, F.posexplode(tx.split_words(F.lower(F.col(text_col)))).alias("pos", "tok"))
        .filter(F.col("tok") != "")
    )
    first = F.min(F.struct(F.col(row_id).alias("row_id"), F.col("pos")))
    raw = toks.groupBy("tok").agg(F.count(F.lit(1)).alias("n"), first.alias("first_seen"))
    words = raw.select(tx.clean_word(F.col("tok")).alias("word"), "n", "first_seen").filter(F.length("word") >= 2)
    return words.groupBy("word").agg(
        F.sum("n").cast("long").alias("freq"), F.min("first_seen").alias("first_seen"),
    )


def frequent_oov(freq: DataFrame, dictionary: Dictionary, min_frequency: int = 2) -> DataFrame:
    """A4 + J4: words seen at least ``min_frequency`` times that are not keys."""
    keys = dictionary.side(dictionary.df.select("key"))
    f = freq.filter(F.col("freq") >= min_frequency)
    return f.join(keys, f["word"] == keys["key"], "left_anti")


def first_seen_top(oov: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` words by first appearance, then by count desc (stable)."""
    head = oov.orderBy("first_seen").limit(n)
    w = Window.orderBy(F.desc("freq"), F.asc("first_seen"))
    return head.select("word", "freq", F.row_number().over(w).alias("rank"))


def top_k(oov: DataFrame, k: int = 20) -> DataFrame:
    """The true top ``k`` by count, ties by word (TakeOrderedAndProject)."""
    head = oov.orderBy(F.desc("freq"), F.asc("word")).limit(k)
    w = Window.orderBy(F.desc("freq"), F.asc("word"))
    return head.select("word", "freq", F.row_number().over(w).alias("rank"))
