"""Dictionary lookup cascade over distinct cleaned words.

The cascade runs once per **distinct** cleaned word (the memo of the
reference), never per token:

* exact   -- equi join on ``clean == key``;
* fuzzy   -- theta join ``|len diff| <= k``, ``distance <= k``,
  ``similarity >= t``, turned into an equi join: on an exploded length bucket
  of the dictionary (small dictionaries) or on shared deletion variants
  (large ones); best candidate per word by ``max_by`` (highest similarity,
  then earliest dictionary position);
* stretch -- collapse letter runs of three or more to two, equi join.

Each stage only answers for the words the previous stages left.  The stage
functions below are the single steps (used by their own queries);
:func:`word_map` runs the whole cascade in one pass over the vocabulary.  The
result holds hits only; a word absent from it is "none".
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.session import cut_lineage
from wordloom.sources.dictionary import MAX_BROADCAST_ROWS, Dictionary

VALUE_COLS = ["value", "value_upper", "value_title", "value_lower"]
WORD_MAP_COLS = ["clean", "stage", "match_key", "ord", *VALUE_COLS, "similarity"]


@dataclass(frozen=True)
class MatchParams:
    """Same meaning as the reference's keyword arguments."""

    levenshtein_threshold: float = 0.8  # minimum similarity
    fuzzy_threshold: int = 2            # maximum edit distance (and length difference)


def exact_matches(vocab: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Words that are keys."""
    d = dictionary.side()
    return vocab.join(d, vocab["clean"] == d["key"], "inner").select(
        "clean", F.lit("exact").alias("stage"), F.col("key").alias("match_key"), "ord",
        *VALUE_COLS, F.lit(None).cast("double").alias("similarity"),
    )


def oov_words(vocab: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Words that are not keys."""
    keys = dictionary.side(dictionary.df.select("key"))
    return vocab.join(keys, vocab["clean"] == keys["key"], "left_anti")


def fuzzy_candidates(words: DataFrame, dictionary: Dictionary, params: MatchParams) -> DataFrame:
    """Every (word, key) pair passing the gate, with distance and similarity.

    The dictionary is exploded to the word lengths it can match
    (``len(key) - k .. len(key) + k``) so the join is an equi join on length
    (hash join) instead of a nested loop over all keys.
    """
    k = params.fuzzy_threshold
    bucket = dictionary.side(
        dictionary.df.select(
            "key", "ord", *VALUE_COLS,
            F.explode(F.sequence(F.length("key") - k, F.length("key") + k)).alias("wlen"),
        ),
        2 * k + 1,
    )
    w = words.select("clean", F.length("clean").alias("clen"))
    pairs = w.join(bucket, w["clen"] == bucket["wlen"], "inner")
    dist = F.levenshtein("clean", "key", k)  # -1 when above k
    sim = tx.similarity(F.col("clean"), F.col("key"), F.col("distance"))
    return (
        pairs.withColumn("distance", dist)
        .filter(F.col("distance") >= 0)
        .withColumn("similarity", sim)
        .filter((F.col("similarity") >= F.lit(float(params.levenshtein_threshold)))
                & (F.col("similarity") > F.lit(0.0)))
    )


def fuzzy_matches(words: DataFrame, dictionary: Dictionary, params: MatchParams) -> DataFrame:
    """J2 + W1: best candidate per word; ties go to the earliest dictionary position."""
    cand = fuzzy_candidates(words, dictionary, params)
    best = F.max_by(
        F.struct("key", "ord", *VALUE_COLS, "similarity"),
        F.struct(F.col("similarity"), -F.col("ord")),
    )
    return cand.groupBy("clean").agg(best.alias("b")).select(
        "clean", F.lit("fuzzy").alias("stage"), F.col("b.key").alias("match_key"), "b.ord",
        *[F.col(f"b.{c}").alias(c) for c in VALUE_COLS], "b.similarity",
    )


def stretch_matches(words: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Collapsed letter runs looked up exactly (only if different and length >= 3)."""
    d = dictionary.side()
    s = (
        words.filter(F.length("clean") >= 3)
        .withColumn("collapsed", tx.destretch(F.col("clean")))
        .filter(F.col("collapsed") != F.col("clean"))
    )
    return s.join(d, s["collapsed"] == d["key"], "inner").select(
        "clean", F.lit("stretch").alias("stage"), F.col("key").alias("match_key"), "ord",
        *VALUE_COLS, F.lit(None).cast("double").alias("similarity"),
    )


def deletion_budget(length: Column, params: MatchParams) -> Column:
    """Most deletions a string of this length can need for a fuzzy hit.

    A pair at distance ``d`` has ``max(len) <= len + d``, so it can pass the
    gate only if ``1 - d / (len + d) >= t`` (same double formula, monotone in
    ``d``): the budget is the largest such ``d <= k`` (0 = exact only).
    """
    t = F.lit(float(params.levenshtein_threshold))
    budget = F.lit(0)
    for d in range(1, params.fuzzy_threshold + 1):
        best = F.lit(1.0) - F.lit(float(d)) / (length + F.lit(d)).cast("double")
        budget = F.when((best >= t) & (best > F.lit(0.0)), F.lit(d)).otherwise(budget)
    return budget


def deletion_variants(s: Column, budget: Column, k: int) -> Column:
    """Distinct strings obtained from ``s`` by deleting 0..``budget`` characters."""
    def drop_each(t: Column) -> Column:
        n = F.greatest(F.length(t), F.lit(1))  # sequence(1, 0) would count down
        return F.transform(F.sequence(F.lit(1), n),
                           lambda i: F.concat(t.substr(F.lit(1), i - 1), t.substr(i + 1, F.lit(1 << 30))))

    levels, cur = [F.array(s)], F.array(s)
    for d in range(1, k + 1):
        cur = F.flatten(F.transform(cur, drop_each))
        levels.append(F.when(budget >= d, cur).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*levels))


def _bucket_candidates(w: DataFrame, dictionary: Dictionary, params: MatchParams) -> DataFrame:
    """(clean, b_key, b_ord) for every key in the word's length window (pruned losslessly)."""
    k = params.fuzzy_threshold
    t = F.lit(float(params.levenshtein_threshold))
    klen = F.length("key")
    rows = dictionary.df.select(
        F.col("key").alias("b_key"), F.col("ord").alias("b_ord"), klen.alias("klen"),
        F.explode(F.sequence(klen - k, klen + k)).alias("wlen"),
    )
    # Length prune (lossless): the smallest distance a pair of lengths allows is
    # max(|L-K|, 1) for different words; if even that fails the similarity
    # gate, the bucket row can only serve an exact match (L == K).
    def best_sim(d: Column) -> Column:
        return F.lit(1.0) - d.cast("double") / F.greatest("wlen", "klen").cast("double")

    min_d = F.greatest(F.abs(F.col("wlen") - F.col("klen")), F.lit(1))
    rows = rows.withColumn("b_fuzzy", (best_sim(min_d) >= t) & (best_sim(min_d) > F.lit(0.0)))
    # Letter prune (lossless): an edit changes at most two bits of the letter mask, and the
    # lengths bound the edits that the similarity gate lets pass.
    max_d = F.lit(0)
    for d in range(1, k + 1):
        max_d = F.when((best_sim(F.lit(d)) >= t) & (best_sim(F.lit(d)) > F.lit(0.0)), F.lit(d)).otherwise(max_d)
    rows = rows.withColumn("b_bits", max_d * 2).withColumn("b_mask", letter_mask(F.col("b_key")))
    bucket = dictionary.side(rows.filter(F.col("b_fuzzy") | (F.col("wlen") == F.col("klen"))), 2 * k + 1)
    ww = w.select("clean", F.length("clean").alias("clen"), letter_mask(F.col("clean")).alias("w_mask"))
    near = F.bit_count(F.col("w_mask").bitwiseXOR(F.col("b_mask"))) <= F.col("b_bits")
    on = (F.col("clen") == F.col("wlen")) & (
        (F.col("clean") == F.col("b_key")) | (F.col("b_fuzzy") & near & passes_gate(params))
    )
    return ww.join(bucket, on, "left").select("clean", "b_key", "b_ord")


def letter_mask(word: Column) -> Column:
    """64 bits: one for every character the word holds, by its code modulo 64."""
    one = F.lit(1).cast("bigint")
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"),
                       lambda mask, c: mask.bitwiseOR(F.call_function("shiftleft", one, F.ascii(c).bitwiseAND(63))))


def _deletion_candidates(w: DataFrame, dictionary: Dictionary, params: MatchParams) -> DataFrame:
    """(clean, b_key, b_ord) for every key sharing a deletion variant with the word.

    Lossless: words within distance ``d`` reach a common string with at most
    ``d`` deletions each, and ``d`` never exceeds either side's budget.  Keys'
    variants are a dictionary-sized table (broadcast under the dictionary's
    bound); each word costs a handful of hash lookups instead of one distance
    per key in its length window, and the work no longer grows with the
    dictionary.
    """
    k = params.fuzzy_threshold
    # the variant table's size depends on key lengths: it is made and counted (dictionary-sized) once for each dictionary
    if params not in dictionary.variants:
        kv = cut_lineage(dictionary.df.select(
            F.col("key").alias("b_key"), F.col("ord").alias("b_ord"),
            F.explode(deletion_variants(F.col("key"), deletion_budget(F.length("key"), params), k)).alias("v"),
        ))
        dictionary.variants[params] = kv, kv.count()
    kv, n_variants = dictionary.variants[params]
    if n_variants <= MAX_BROADCAST_ROWS:
        kv = F.broadcast(kv)
    # a word too long or too short for every key stands for itself alone: its variants grow with its length squared
    lo, hi = dictionary.key_lengths
    n = F.length("clean")
    budget = F.when(n.between(max(lo - k, 0), hi + k), deletion_budget(n, params)).otherwise(F.lit(0))
    wv = w.select("clean", F.explode(deletion_variants(F.col("clean"), budget, k)).alias("w_v"))
    on = (F.col("w_v") == F.col("v")) & ((F.col("clean") == F.col("b_key")) | passes_gate(params))
    return wv.join(kv, on, "left").select("clean", "b_key", "b_ord")


def passes_gate(params: MatchParams) -> Column:
    """The fuzzy gate on a (clean, b_key) pair, evaluated inside the join so
    pairs that fail never leave it: distance <= k, similarity >= t (and > 0)."""
    t = F.lit(float(params.levenshtein_threshold))
    dist = F.levenshtein(F.col("clean"), F.col("b_key"), params.fuzzy_threshold)
    sim = tx.similarity(F.col("clean"), F.col("b_key"), dist)
    return (dist >= 0) & (sim >= t) & (sim > F.lit(0.0))


# Dictionaries up to this many keys use length buckets; larger ones deletion variants.
BUCKET_MAX_KEYS = 2_000


def word_map(vocab: DataFrame, dictionary: Dictionary, params: MatchParams = MatchParams(),
             strategy: str = "auto") -> DataFrame:
    """The cascade exact -> fuzzy -> stretch over distinct words, in one pass; hits only.

    ``vocab`` has one column ``clean`` with distinct, non-empty cleaned words.
    Candidates come from ``strategy``: "bucket" (keys in the word's length
    window; cheapest for small dictionaries) or "deletion" (shared deletion
    variants; cost independent of dictionary size); "auto" picks by the
    dictionary's key bound.  Both are exact supersets of the pairs that can
    pass the gate.  An exact key has distance 0 and
    similarity 1.0, so the best gated candidate is the exact key when there is
    one and the best fuzzy key otherwise: exact and fuzzy are one left join
    plus ``max_by`` per word.  Stretch is one more join on the collapsed form,
    used only where no candidate passed.  The vocabulary is read once; the
    joins keep its partitioning by word, so the per-word aggregate needs no
    further exchange.
    """
    k = params.fuzzy_threshold
    if strategy == "auto":
        strategy = "bucket" if dictionary.max_keys <= BUCKET_MAX_KEYS else "deletion"
    make = _deletion_candidates if strategy == "deletion" else _bucket_candidates
    # left join: every word once with no key, or once per key that passed the gate
    cand = make(vocab.select("clean"), dictionary, params)
    # no key passed and no run to collapse: no stage can answer, so the word need not be sorted and grouped
    cand = cand.filter(F.col("b_key").isNotNull() | F.col("clean").rlike(tx.STRETCH_RUN))
    cand = cand.withColumn(
        "sim", F.when(F.col("b_key").isNotNull(),
                      tx.similarity(F.col("clean"), F.col("b_key"), F.levenshtein(F.col("clean"), F.col("b_key"), k)))
    )
    best = cand.groupBy("clean").agg(
        F.max_by(F.struct(F.col("b_key").alias("key"), F.col("sim")),
                 F.when(F.col("b_key").isNotNull(), F.struct(F.col("sim"), -F.col("b_ord")))).alias("best")
    )
    # stretch candidates: only where no key passed the gate
    collapsed = F.when(
        F.col("best.key").isNull() & (F.length("clean") >= 3), tx.destretch(F.col("clean"))
    )
    staged = best.withColumn("collapsed", collapsed).withColumn(
        "match_key",
        F.when(F.col("best.key").isNotNull(), F.col("best.key"))
        .when(F.col("collapsed") != F.col("clean"), F.col("collapsed")),
    )
    d = dictionary.side()
    hits = staged.join(d, staged["match_key"] == d["key"], "inner")
    stage = (
        F.when(F.col("best.key").isNull(), F.lit("stretch"))
        .when(F.col("best.sim") == F.lit(1.0), F.lit("exact"))
        .otherwise(F.lit("fuzzy"))
    )
    return hits.select(
        "clean", stage.alias("stage"), "match_key", "ord", *VALUE_COLS,
        F.when(F.col("best.key").isNotNull() & (F.col("best.sim") < F.lit(1.0)), F.col("best.sim")).alias("similarity"),
    )


def word_map_staged(vocab: DataFrame, dictionary: Dictionary, params: MatchParams = MatchParams()) -> DataFrame:
    """J6 written stage by stage with ``left_anti`` between stages (reference form).

    Same result as :func:`word_map`; kept for tests and for reading.  Catalyst
    pushes each anti join below the vocabulary aggregate, so the vocabulary is
    recomputed per stage -- use :func:`word_map` in pipelines.
    """
    exact = exact_matches(vocab, dictionary)
    rest = oov_words(vocab, dictionary)
    fuzzy = fuzzy_matches(rest, dictionary, params)
    rest2 = rest.join(fuzzy.select("clean"), "clean", "left_anti")
    stretch = stretch_matches(rest2, dictionary)
    return exact.select(WORD_MAP_COLS).unionByName(fuzzy.select(WORD_MAP_COLS)).unionByName(
        stretch.select(WORD_MAP_COLS)
    )
