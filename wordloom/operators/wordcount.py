"""How often every word occurs in a table of texts, without a row per occurrence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_counts(df: DataFrame, text: Column, min_length: int = 1) -> DataFrame:
    """(word, n): the whitespace words of ``min_length`` characters or more.

    Each Arrow batch of texts is split and counted by itself (Arrow's whitespace is Python's), so a frequent
    word costs one row a batch; Spark adds the counts up by word.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.list_flatten(pc.utf8_split_whitespace(batch.column(0)))
            counts = pc.value_counts(words)
            yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], names=["word", "n"])

    parts = df.select(F.make_valid_utf8(text).alias("text")).mapInArrow(counted, "word string, n long")
    return parts.filter(F.length("word") >= min_length).groupBy("word").agg(F.sum("n").alias("n"))
