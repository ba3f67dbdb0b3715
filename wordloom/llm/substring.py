"""Substring deduplication: words in windows that an earlier document holds, and the factors they make up.

Every document is a reference block for the documents with larger ids.  The
index of all blocks is kept by windows of ``span`` words (the shortest factor
that counts): each distinct window points to its first place, the smallest
(doc_id, word).  What is removed is decided by an exact join of windows: a word goes
if some window over it is in the index with an earlier document.

This stands in place of a greedy relative Lempel-Ziv parse.  Its factors of ``span`` words or more, together with
the windows across their ends, cover the same words, since a window that an earlier document holds
lies inside one such factor or across the end of one; but the longest match at a word needs all places of its window, not only the first, and
their number is not bounded for a hot window.  ``factors`` therefore lists runs of covered windows that point to consecutive
words of one reference: places in earlier documents, not always the longest ones.

A text that an earlier document has too, character by character, is one factor; it
needs no windows and adds none to the index.  Of the other texts only windows that can repeat enter
the index.  They first give their
winnowed fingerprints (``winnow``; about two per ``span`` words); equal windows
have equal fingerprints, so a window whose fingerprint no second document has
is unique.  Fingerprints are counted with partial aggregation before the shuffle.  Windows whose
fingerprint ``HOT_DOCS`` documents or fewer have meet in one sorted shuffle, in groups of that size;
those of the others are aggregated before the shuffle and joined, so no group lands in one task.

Defined cases.  Null, empty and wordless texts have no words and keep nothing
(the hash of no bytes).  Texts shorter than a window lose nothing.  Rows with equal ids are
parsed one by one and are no reference for each other; a null id is no reference
and its row loses nothing.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm import common as cm
from wordloom.llm import winnow as wn

SPAN = 13
HOT_DOCS = 50


def _fingerprints(docs: DataFrame, span: int) -> DataFrame:
    def run(rows, texts):
        words = cm.words_of(texts, cm.SPACED, False)
        at, marks = wn.fingerprints(words, span)
        new = np.ones(len(at), bool)
        new[1:] = marks[1:] != marks[:-1]  # neighbours mostly share one
        new[1:] |= np.searchsorted(words.first, at[1:], "right") != np.searchsorted(words.first, at[:-1], "right")
        at, marks = at[new], marks[new]
        row = np.searchsorted(words.first, at, "right") - 1
        keep = wn.distinct_per_row(row, marks)
        return {"id": rows["id"].take(pa.array(row[keep])), "mark": marks[keep]}

    kind = docs.schema["id"].dataType.simpleString()
    return cm.map_texts(docs, run, f"id {kind}, mark bigint")


def _candidates(docs: DataFrame, span: int) -> DataFrame:
    """Distinct windows of each row whose fingerprint is in its list ``marks``."""
    def run(rows, texts):
        words = cm.words_of(texts, cm.SPACED, False)
        at, marks = wn.fingerprints(words, span)
        row = np.searchsorted(words.first, at, "right") - 1
        shared = _members(rows["marks"], row, marks)
        at, row = at[shared], row[shared]
        low, high = wn.windows(words, at, span)  # 64 + 31 bits name a window: enough for 10**14 of them
        keep = wn.distinct_per_row(row, low)
        return {"low": low[keep], "high": (high[keep] >> cm.U64(33)).astype(np.int32), "id": rows["id"].take(pa.array(row[keep])), "place": (at - words.first[row])[keep]}

    kind = docs.schema["id"].dataType.simpleString()
    return cm.map_texts(docs, run, f"low bigint, high int, id {kind}, place bigint")


def _members(listed: pa.Array, row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in the list of its row."""
    return _positions(listed, row, values) >= 0


def _positions(listed: pa.Array, row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place in the flattened lists of each value in the list of its row, or -1."""
    flat = listed.flatten()
    flat = (flat.field(0) if pa.types.is_struct(flat.type) else flat).to_numpy(zero_copy_only=False).view(cm.U64)
    size = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(size)), size)
    out = np.full(len(values), -1)
    if not len(flat) or not len(values):
        return out
    # one sorted table of (row, value): both mixed into 128 bits would be slower than two sorts
    names, codes = np.unique(np.concatenate([flat, values]), return_inverse=True)
    have, want = owner * len(names) + codes[: len(flat)], row * len(names) + codes[len(flat):]
    order = np.argsort(have)
    at = np.minimum(np.searchsorted(have[order], want), len(have) - 1)
    hit = have[order][at] == want
    out[hit] = order[at[hit]]
    return out


def _parse(docs: DataFrame, span: int) -> DataFrame:
    """Factors and kept words of rows with their index entries ``entries``."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(rows, texts):
        words = cm.words_of(texts, cm.SPACED, False)
        sizes = np.diff(words.first)
        row = np.repeat(np.arange(len(texts)), sizes)
        last = np.repeat(words.first[1:], sizes)
        listed = rows["entries"]
        at = np.flatnonzero((last - np.arange(len(row)) >= span) & (pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False) > 0)[row])
        entry = _positions(listed, row[at], wn.windows(words, at, span)[0])
        at, entry = at[entry >= 0], entry[entry >= 0]
        gone = wn.covered(len(row), at, span)
        whole = rows["whole"].is_valid().to_numpy(zero_copy_only=False) & (sizes >= span)
        gone |= whole[row]
        factors = _factors(listed.flatten(), at, entry, row, words.first, span, len(texts), rows["whole"], np.flatnonzero(whole))
        kept = []
        for r, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
            own = text.split()  # bytes: the six ASCII spaces
            mask = gone[words.first[r]: words.first[r + 1]]
            kept.append(b" ".join(compress(own, ~mask) if mask.any() else own))
        removed = np.concatenate([[0], np.cumsum(gone)])[words.first]
        return {
            "id": rows["id"], "n_words": sizes, "n_removed": np.diff(removed), "factors": factors,
            "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept], "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        }

    return cm.map_texts(docs, run, f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string, factors {_factor_type(kind)}")


def _factor_type(kind: str) -> str:
    return f"array<struct<start:bigint,words:bigint,ref:{kind},ref_start:bigint>>"


def _factors(entries: pa.Array, at: np.ndarray, entry: np.ndarray, row: np.ndarray, first: np.ndarray, span: int, n: int, wholes: pa.Array, whole: np.ndarray) -> pa.Array:
    """Runs of windows that point to consecutive words of one reference, and whole texts."""
    refs, places = pc.struct_field(entries, 1).take(pa.array(entry)), pc.struct_field(entries, 2).take(pa.array(entry)).to_numpy(zero_copy_only=False)
    codes = refs.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    begin = np.ones(len(at), bool)
    begin[1:] = (np.diff(at) != 1) | (np.diff(codes) != 0) | (np.diff(places) != 1) | (row[at[1:]] != row[at[:-1]])
    start = np.flatnonzero(begin)
    length = np.diff(np.append(start, len(at))) + span - 1
    own = np.concatenate([row[at[start]], whole])
    order = np.argsort(own, kind="stable")
    zero = np.zeros(len(whole), np.int64)
    structs = pa.StructArray.from_arrays([
        pa.array(np.concatenate([at[start] - first[row[at[start]]], zero])[order]), pa.array(np.concatenate([length, first[whole + 1] - first[whole]])[order]),
        pa.concat_arrays([refs.take(pa.array(start)), wholes.take(pa.array(whole))]).take(pa.array(order)), pa.array(np.concatenate([places[start], zero])[order]),
    ], names=["start", "words", "ref", "ref_start"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(own[order], np.arange(n + 1)).astype(np.int32)), structs)


def remove_repeats(docs: DataFrame, span: int = SPAN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text, factors -- a row per input row."""
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    named = docs.where("id is not null")
    dealt = named.repartition("id")  # one exchange of the texts, read by all passes
    texts = named.select("id", F.md5("text").alias("md5"))
    firsts = texts.groupBy("md5").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("md5", "first")
    copies = texts.join(firsts, "md5").where("first < id").groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("md5", "first"))).alias("copies"))
    tagged = dealt.join(copies, "id", "left").select("id", "text", F.col("copies")[F.md5("text")].alias("whole"))
    marks = _fingerprints(tagged.where("whole is null").drop("whole"), span)
    shared = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = F.col("n") > HOT_DOCS
    per_doc = marks.join(shared, "mark").groupBy("id").agg(
        F.collect_list(F.when(~hot, F.col("mark"))).alias("few"), F.collect_list(F.when(hot, F.col("mark"))).alias("many"))
    found = lambda c: _candidates(tagged.where("whole is null").drop("whole").join(per_doc.where(F.size(c) > 0).select("id", F.col(c).alias("marks")), "id"), span)
    entry = F.struct("low", "ref", "ref_start")
    # equal windows have equal fingerprints, so a window lies wholly on one side
    same = Window.partitionBy("low", "high").orderBy("id", "place")  # at most HOT_DOCS documents
    few = found("few").select("low", "id", F.first("id").over(same).alias("ref"), F.first("place").over(same).alias("ref_start"))
    many = found("many")
    index = many.groupBy("low", "high").agg(F.min(F.struct("id", "place")).alias("first")).select("low", "high", "first")
    many = many.select("low", "high", "id").join(index, ["low", "high"]).select("low", "id", F.col("first.id").alias("ref"), F.col("first.place").alias("ref_start"))
    entries = few.unionByName(many).where("ref < id").groupBy("id").agg(F.collect_list(entry).alias("entries"))
    nothing = F.lit(None).cast(entries.schema["entries"].dataType)
    parsed = _parse(tagged.join(entries, "id", "left").withColumn("entries", F.when(F.col("whole").isNull(), F.col("entries"))), span)
    unnamed = docs.where("id is null").withColumn("whole", F.lit(None).cast(docs.schema["id"].dataType)).withColumn("entries", nothing)
    parsed = parsed.unionByName(_parse(unnamed, span))
    return parsed.withColumnRenamed("id", doc_id)
