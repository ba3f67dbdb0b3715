"""Temperature mixing of sources to target weights.

With p a source's share of all tokens, its weight is p ** alpha / sum(p ** alpha).
The exponent is found by bisection: the weights' entropy falls as alpha rises, and so does the
repetition (how often the most repeated source is read while the least repeated one is read once);
``target_entropy`` (a share of the logarithm of the number of sources) and
``max_repeats`` each give the exponent that meets them, and the larger one holds.
Sums over sources stay in Spark: each round of the bisection is one
aggregation of the table of sources, and only scalars reach the driver.

Weights become budgets of tokens, and budgets blocks: block b of a source is all of
its documents in the order of md5(source / b / doc_id).  Whole blocks are
taken while the budget lasts; of the next block the documents up to the first
that reaches the budget.  The cut is found from token sums of hash buckets (about
``bucket_docs`` documents each), so no source is sorted in one task.  Without a ``budget`` the least repeated source
is read exactly once, so no document is lost.

Defined cases.  A null source is the source ''.  Null and empty texts have 0 tokens; a source without
tokens has no weight and is read once.  A null doc_id permutes as ''.  Repeated rows are rows of
their own with equal place in a block.  Other columns, whatever their names, are carried along.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm import common as cm

GRID = 16      # exponents tried in one aggregation
ROUNDS = 12    # 16 ** 12 steps in all: beyond double precision


@dataclass(frozen=True)
class Mix:
    target_entropy: float | None = 0.9
    max_repeats: float | None = 2.0
    budget: int | None = None     # tokens; None: the least repeated source once
    bucket_docs: int = 10_000


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def entropy_exponent(shares: DataFrame, target: float) -> float:
    """Exponent in 0..1 whose weights have ``target`` * ln(number of sources) entropy (1 if natural shares have as much)."""
    low, high = 0.0, 1.0
    n = shares.count()
    for _ in range(ROUNDS):
        steps = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        sums = [f(F.exp(F.log("p") * a) * k) for a in steps for f, k in ((F.sum, F.lit(1.0)), (F.sum, F.log("p")))]
        got = shares.agg(*sums).first()
        entropy = [math.log(got[2 * i]) - a * got[2 * i + 1] / got[2 * i] for i, a in enumerate(steps)]
        above = [i for i, h in enumerate(entropy) if h >= target * math.log(n)]
        at = max(above, default=0)
        if at == GRID or high - low < 1e-15:
            return steps[at]
        low, high = steps[at], steps[at + 1]
    return low


def repeat_exponent(least: float, most: float, limit: float) -> float:
    """Smallest exponent at which the rarest source is read at most ``limit`` times as often as the largest."""
    if least <= 0 or least == most or most / least <= limit:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (most / least) ** (1 - mid) <= limit else (mid, high)
    return high


def _rank(block: Column, doc_id: str = "doc_id") -> Column:
    return F.md5(F.concat_ws("/", "source", block.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def plan(docs: DataFrame, m: Mix = Mix()) -> DataFrame:
    """source, weight, n_tokens, whole (blocks taken in full), cut (last place taken of the next block, '' for none)."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), tokens_of(F.col("text")).alias("n_tokens"))
    totals = cm.checkpointed(rows.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")))
    all_tokens = totals.agg(F.sum("t")).first()[0] or 0
    shares = totals.where("t > 0").select("source", "t", "n", (F.col("t") / F.lit(float(all_tokens or 1))).alias("p"))
    least, most = shares.agg(F.min("p"), F.max("p")).first()
    if least is None:
        return totals.select("source", F.lit(0.0).alias("weight"), F.col("t").alias("n_tokens"), F.lit(1).cast("bigint").alias("whole"), F.lit("").alias("cut"))
    found = [0.0] + ([entropy_exponent(shares, m.target_entropy)] if m.target_entropy is not None else [])
    alpha = max(found + ([repeat_exponent(least, most, m.max_repeats)] if m.max_repeats is not None else []))
    norm = shares.agg(F.sum(F.exp(F.log("p") * alpha))).first()[0]
    per_weight = m.budget if m.budget is not None else all_tokens * most / math.exp(alpha * math.log(most)) * norm
    weighted = totals.join(shares.select("source", (F.exp(F.log("p") * alpha) / norm).alias("weight")), "source", "left").select(
        "source", "n", F.col("t").alias("n_tokens"), F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.when(F.col("t") > 0, F.round(F.col("weight") * per_weight).cast("bigint")).otherwise(F.lit(0)).alias("wanted"))
    weighted = weighted.withColumn("whole", F.when(F.col("n_tokens") > 0, F.floor(F.col("wanted") / F.greatest("n_tokens", F.lit(1)))).otherwise(F.lit(1)).cast("bigint"))
    weighted = cm.checkpointed(weighted.withColumn("rest", F.when(F.col("n_tokens") > 0, F.col("wanted") - F.col("whole") * F.col("n_tokens")).otherwise(F.lit(0))))
    small = cm.small_or_plain(weighted, weighted.count())
    placed = rows.join(small.select("source", "whole", "rest", "n").where("rest > 0"), "source").withColumn("rank", _rank(F.col("whole")))
    part = F.floor(F.conv(F.substring("rank", 1, 8), 16, 10).cast("double") / 2.0**32 * F.ceil(F.col("n") / m.bucket_docs)).alias("bucket")
    placed = placed.select("source", "rest", "n_tokens", "rank", part)
    buckets = placed.groupBy("source", "bucket", "rest").agg(F.sum("n_tokens").alias("b"))
    before = F.coalesce(F.sum("b").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = buckets.withColumn("before", before).where("before < rest and before + b >= rest").select("source", "bucket", "before")
    up_to = Window.partitionBy("source", "bucket").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = F.sum("n_tokens").over(up_to) - F.col("n_tokens")
    inside = placed.join(cuts, ["source", "bucket"]).withColumn("at", F.col("before") + within)
    cut = inside.where("at < rest").groupBy("source").agg(F.max("rank").alias("cut"))
    return weighted.join(cut, "source", "left").select("source", "weight", "n_tokens", "whole", F.coalesce("cut", F.lit("")).alias("cut"))


def taken(docs: DataFrame, m: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """row (a struct with all columns of ``docs``), block (from 0), rank (order within the block) of every taken row."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    chosen = cm.checkpointed(plan(named, m).select("source", "whole", "cut"))
    chosen = cm.small_or_plain(chosen, chosen.count())
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"))
    out = rows.join(chosen, "source").withColumn("blocks", F.col("whole") + (_rank(F.col("whole")) <= F.col("cut")).cast("bigint"))
    out = out.where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return out.select("row", "block", _rank(F.col("block")).alias("rank"))


def mixed(docs: DataFrame, m: Mix = Mix(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Every taken row of ``docs`` with all its columns, plus ``mix_block`` and ``mix_rank`` (with underscores after them if ``docs`` has such columns)."""
    rows = taken(docs, m, doc_id, text, source)
    return rows.select("row.*", *[F.col(c).alias(cm.free_name(f"mix_{c}", docs)) for c in ("block", "rank")])
