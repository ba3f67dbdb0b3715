"""Fixed-length encoding of normalised texts (M1, re-aimed).

The reference feeds a pre-trained sub-word tokenizer (not available here).
The Spark job keeps its contract -- ids, attention mask, truncate and pad to
``max_length`` with start / end / pad / unknown specials -- with a word
vocabulary learned from the train split at scale:

* vocabulary: every train token, ids by falling frequency (ties by token) after
  the specials.  Counts are range-partitioned in that order; a token's id is its
  place in its partition plus the sizes of the partitions before.
* encoding: tokens exploded with position, joined with the vocabulary (its most
  frequent short tokens by broadcast, the rest in a salted shuffle), regrouped
  per row in position order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.operators.layout import spread_by
from wordloom.operators.wordcount import word_counts
from wordloom.session import cut_lineage

# Special token ids.
START_ID, PAD_ID, END_ID, UNKNOWN_ID = 0, 1, 2, 3
FIRST_WORD_ID = 4

# The broadcast part of a vocabulary: at most this many tokens of at most this many bytes.
HEAD_WORDS = 200_000
HEAD_BYTES = 128
# Salts of the join with the rest, which only a token unseen in training or a long one can skew.
SALT_BUCKETS = 8


@dataclass(frozen=True)
class EncoderParams:
    max_length: int = 512


def encoder_tokens(df: DataFrame, text_col: str = "text", row_id: str = "row_id") -> DataFrame:
    """Lower-cased whitespace tokens with position."""
    return (
        df.filter(F.col(text_col).isNotNull())
        .select(row_id, F.posexplode(tx.split_words(F.lower(F.col(text_col)))).alias("pos", "tok"))
        .filter(F.col("tok") != "")
    )


def learn_vocabulary(train: DataFrame, text_col: str = "text", row_id: str = "row_id") -> DataFrame:
    """(tok, id): every train token, the most frequent first, ids from FIRST_WORD_ID."""
    counts = word_counts(spread_by(train.select(row_id, text_col), row_id), F.lower(F.col(text_col))).withColumnRenamed("word", "tok")
    order = [F.desc("n"), F.asc("tok")]
    # written once, so that places and partitions stay as they are when a task is repeated
    placed = cut_lineage(
        counts.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("tok", F.monotonically_increasing_id().alias("place"))
    ).select("tok", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("place"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    starts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size")).select(
        "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")
    )
    return placed.join(F.broadcast(starts), "part").select(
        "tok", (F.col("start") + F.col("place") + FIRST_WORD_ID).cast("int").alias("id")
    )


def _token_ids(toks: DataFrame, vocab: DataFrame, row_id: str) -> DataFrame:
    """row_id, pos, id (null for a token outside the vocabulary)."""
    frequent = (F.col("id") < FIRST_WORD_ID + HEAD_WORDS) & (F.octet_length("tok") <= HEAD_BYTES)
    headed = toks.join(F.broadcast(vocab.filter(frequent)), "tok", "left")
    tail = vocab.filter(~frequent)
    if tail.isEmpty():
        return headed.select(row_id, "pos", "id")
    salts = F.array(*[F.lit(i).cast("long") for i in range(SALT_BUCKETS)])
    rest = headed.filter(F.col("id").isNull()).select(
        row_id, "pos", "tok", F.pmod(F.xxhash64(row_id, "pos"), F.lit(SALT_BUCKETS)).alias("salt"))
    found = rest.join(tail.withColumn("salt", F.explode(salts)), ["tok", "salt"], "left")
    return headed.filter(F.col("id").isNotNull()).select(row_id, "pos", "id").unionByName(
        found.select(row_id, "pos", "id"))


def encode(df: DataFrame, vocab: DataFrame, params: EncoderParams = EncoderParams(),
           text_col: str = "text", row_id: str = "row_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """row_id, carried columns, input_ids array<int>[max_length], attention_mask array<int>[max_length].

    Rows with no token still get ``[start, end, pad...]``.
    """
    keep = params.max_length - 2
    base = spread_by(df.select(row_id, text_col, *carry), row_id)
    toks = encoder_tokens(base, text_col, row_id).filter(F.col("pos") < keep)
    ids = _token_ids(toks, vocab, row_id).withColumn("id", F.coalesce("id", F.lit(UNKNOWN_ID)))
    grouped = ids.groupBy(row_id).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("body")
    )
    rows = base.select(row_id, *carry).join(grouped, row_id, "left")
    body = F.coalesce(F.col("body"), F.array().cast("array<int>"))
    real = F.concat(F.array(F.lit(START_ID)), body, F.array(F.lit(END_ID)))
    n_pad = F.lit(params.max_length) - F.size(real)
    return rows.select(
        row_id, *carry,
        F.concat(real, F.array_repeat(F.lit(PAD_ID), n_pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size(real)), F.array_repeat(F.lit(0), n_pad)).alias("attention_mask"),
    )
