"""Query inputs derived from the driver tables.

* comments  := documents(doc_id -> row_id, text + one dirty snippet), split by
  ``doc_id % 10`` (0-7 train, 8 val, 9 test).  Every document is kept with its
  whole text; the snippet only adds words the dictionary can hit.  So that the
  blank-row filter has work, two residues of ``doc_id % 50`` bring one more row
  each, with a null / blank text and the id ``-1 - doc_id``.
* labelled  := comments inner join labels; label = quality as string; the
  stand-in prediction (for metric queries that must not depend on a model)
  is "1" when the document is not toxic, else "0".
* video feed := conversations(conv_id -> video id, turn, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Dirty snippets appended to the test documents (FIXTURES §4), in order.
SNIPPETS = [
    "vdo was GUD, thx!",
    "Semma vera level da",
    "nallllla masssssss (plz) subscribe",
    "would u, could hopes place",
    "thankyou thumbsup veralevel",
    "superrrrr soooooo coooool",
    "Awsum WANNA wAnNa Gr8 2, 4!",
    "*** -- நன்றி! வணக்கம்",
    "powerfulllll beautifulll amazinggg",
    "voulda vedioz channels adipolli",
    "  tabs\tand\n\nlines  #hope @dm ",
    "encouragi inspire dream goal",
]
BLANK_TEXT = "  \t\n  "
NULL_RESIDUE, BLANK_RESIDUE = 7, 8
VIDEO_URL_PREFIX = "https://www.youtube.com/watch?v="
SPLITS = ("train", "val", "test")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(row_id: Column) -> Column:
    m = F.pmod(row_id, F.lit(10))
    return F.when(m < 8, F.lit("train")).when(m == 8, F.lit("val")).otherwise(F.lit("test"))


def split_order(split: Column) -> Column:
    return F.when(split == "train", 0).when(split == "val", 1).otherwise(2)


def dirty_text(doc_id: Column, text: Column) -> Column:
    snippet = F.element_at(F.array(*[F.lit(s) for s in SNIPPETS]), (F.pmod(doc_id, F.lit(len(SNIPPETS))) + 1).cast("int"))
    return F.concat(text, F.lit(" "), snippet)


def as_comments(documents: DataFrame) -> DataFrame:
    """Comments of a documents table or stream: every document, then the added blank rows."""
    doc_id = F.col("doc_id")
    m = F.pmod(doc_id, F.lit(50))
    real = documents.select(
        doc_id.alias("row_id"), split_of(doc_id).alias("split"), dirty_text(doc_id, F.col("text")).alias("text"),
        "lang", "source",
    )
    blank = documents.filter(m.isin(NULL_RESIDUE, BLANK_RESIDUE)).select(
        (F.lit(-1) - doc_id).alias("row_id"), split_of(doc_id).alias("split"),
        F.when(m == BLANK_RESIDUE, F.lit(BLANK_TEXT)).alias("text"), "lang", "source",
    )
    return real.unionByName(blank)


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, split, text, lang, source -- one row per document, and the added blank rows."""
    return as_comments(table(spark, sf_dir, "documents"))


def labelled_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, split, text, label, pred -- documents that carry a label."""
    lab = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").cast("string").alias("label"),
        F.when(F.col("toxic") == 1, F.lit("0")).otherwise(F.lit("1")).alias("pred"),
    )
    c = comments(spark, sf_dir).select("row_id", "split", "text")
    return c.join(lab, "row_id", "inner")


def video_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comment feed: video_id, turn, role, text (one row per comment)."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("video_id"), "turn", "role", "text"
    )


def video_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request URL per video of the feed (the documented API's input)."""
    return (
        table(spark, sf_dir, "conversations").select("conv_id").distinct()
        .select(F.concat(F.lit(VIDEO_URL_PREFIX), F.col("conv_id").cast("string")).alias("url"))
    )
