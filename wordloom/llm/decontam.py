"""Benchmark decontamination by winnowing.

A window is ``span`` consecutive words of a benchmark item; an item of fewer
words, but not none, is one window.  Training texts and items keep the least
k-gram hash of every window (``winnow``): as equal windows choose equal
fingerprints, every shared run of a window's length is met in the join of
fingerprints.  A hit is then extended over the whole window (128 bits of hash
over its words), and the words in any occurring window are hit.  Windows of each
length that items have (``span`` and shorter ones) are fingerprinted separately.

The benchmark's windows are counted first.  Within ``BROADCAST_WINDOWS`` they
go to every task and texts are never shuffled; beyond it the same windows are
found by two shuffled joins (fingerprints first, then the windows they met).

Defined cases.  Null, empty and wordless texts have no words and no hits; such
items have no window.  Repeated rows are judged one by one; items with equal ids count once.  A null
item id counts as the empty string.  With an empty benchmark nothing is hit.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import common as cm
from wordloom.llm import winnow as wn

SPAN = 10
BROADCAST_WINDOWS = 2_000_000  # 50 bytes each in a task


def item_windows(items: DataFrame, span: int, item_id: str, text: str) -> DataFrame:
    """span, mark, low, high, item: the distinct windows of each item."""
    def run(rows, texts):
        words = cm.words_of(texts, cm.ALNUM, True)
        size = np.minimum(np.diff(words.first), span)
        parts = []
        for n in np.unique(size[size > 0]):
            at, marks = wn.fingerprints(words, int(n))
            row = np.searchsorted(words.first, at, "right") - 1
            own = size[row] == n
            parts.append((np.full(own.sum(), n), marks[own], *(h[own] for h in wn.windows(words, at, int(n))), row[own]))
        if not parts:
            return None
        n, marks, low, high, row = (np.concatenate(x) for x in zip(*parts, strict=True))
        return {"span": n, "mark": marks, "low": low, "high": high, "item": rows["item"].take(pa.array(row))}

    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return cm.map_texts(items, run, "span int, mark bigint, low bigint, high bigint, item string").distinct()


class _Index:
    """The benchmark's windows as sorted arrays, for one task."""

    def __init__(self, rows: pa.Table):
        self.by_span = {}
        spans = rows["span"].to_numpy()
        items = rows["item"].combine_chunks().dictionary_encode() if len(rows) else None
        for n in np.unique(spans):
            own = spans == n
            low, high, mark = (rows[c].to_numpy()[own].view(cm.U64) for c in ("low", "high", "mark"))
            order = np.lexsort((high, low))
            codes = items.indices.to_numpy(zero_copy_only=False)[own]
            self.by_span[int(n)] = np.unique(mark), low[order], high[order], codes[order]
        self.items = np.array(items.dictionary.to_pylist() if items is not None else [], object)

    def hits(self, words: cm.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hit words (mask), and (row, item code) of occurring items."""
        hit, rows, codes = np.zeros(len(words.hashes), bool), [], []
        for n, (marks, low, high, items) in self.by_span.items():
            at, mine = wn.fingerprints(words, n)
            met = np.minimum(np.searchsorted(marks, mine), len(marks) - 1)
            at = at[marks[met] == mine]
            a, b = wn.windows(words, at, n)
            begin, end = np.searchsorted(low, a, "left"), np.searchsorted(low, a, "right")
            found = np.flatnonzero(end > begin)
            at, b, begin, count = at[found], b[found], begin[found], (end - begin)[found]
            each = np.repeat(np.arange(len(at)), count)
            entry = begin[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            same = high[entry] == b[each]
            each, entry = each[same], entry[same]
            hit |= wn.covered(len(hit), at[np.unique(each)], n)
            rows.append(np.searchsorted(words.first, at[each], "right") - 1)
            codes.append(items[entry])
        if not rows:
            return hit, np.empty(0, np.int64), np.empty(0, np.int64)
        return hit, np.concatenate(rows), np.concatenate(codes)


SCHEMA = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def _row_results(words: cm.Words, hit: np.ndarray, items: list[list[str]]) -> dict:
    total = np.concatenate([[0], np.cumsum(hit)])[words.first]
    n_hit = np.diff(total)
    digests: dict[tuple, str] = {}
    for names in {tuple(x) for x in items}:
        digests[names] = hashlib.sha256(",".join(names).encode()).hexdigest()
    return {
        "n_words": np.diff(words.first), "n_hit": n_hit, "n_items": np.array([len(x) for x in items]),
        "items_sha256": [digests[tuple(x)] for x in items], "contaminated": n_hit > 0,
    }


def _in_tasks(docs: DataFrame, windows: DataFrame, kind: str) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(_Index(windows.toArrow()))

    def run(rows, texts):
        words = cm.words_of(texts, cm.ALNUM, True)
        hit, row, code = index.value.hits(words)
        names: list[list[str]] = [[] for _ in range(len(texts))]
        keep = wn.distinct_per_row(row, code)
        for r, name in zip(row[keep], index.value.items[code[keep]], strict=True):
            names[r].append(name)
        return {"id": rows["id"], **_row_results(words, hit, [sorted(x) for x in names])}

    return cm.map_texts(docs, run, f"id {kind}, {SCHEMA}")


def _by_joins(docs: DataFrame, windows: DataFrame, kind: str) -> DataFrame:
    spans = sorted(r.span for r in windows.select("span").distinct().collect())  # at most SPAN values

    def marks_of(rows, texts):
        words = cm.words_of(texts, cm.ALNUM, True)
        parts = []
        for n in spans:
            at, marks = wn.fingerprints(words, n)
            row = np.searchsorted(words.first, at, "right") - 1
            keep = wn.distinct_per_row(row, marks)
            parts.append((np.full(len(keep), n), marks[keep], row[keep]))
        n, marks, row = (np.concatenate(x) for x in zip(*parts, strict=True))
        return {"key": rows["key"].take(pa.array(row)), "span": n, "mark": marks}

    def windows_of(rows, texts):
        words = cm.words_of(texts, cm.ALNUM, True)
        met, owner = rows["met"].flatten(), None
        size = pc.list_value_length(rows["met"]).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(texts)), size)
        met_span, met_mark = met.field(0).to_numpy(zero_copy_only=False), met.field(1).to_numpy(zero_copy_only=False).view(cm.U64)
        parts = []
        for n in spans:
            at, marks = wn.fingerprints(words, n)
            row = np.searchsorted(words.first, at, "right") - 1
            own = met_span == n
            names, codes = np.unique(np.concatenate([met_mark[own], marks]), return_inverse=True)
            known = np.isin(row * len(names) + codes[own.sum():], owner[own] * len(names) + codes[: own.sum()])
            at, row = at[known], row[known]
            low, high = wn.windows(words, at, n)
            parts.append((np.full(len(at), n), low, high, row, at - words.first[row]))
        n, low, high, row, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        return {"key": rows["key"].take(pa.array(row)), "span": n, "low": low, "high": high, "place": place}

    def result(rows, texts):
        words = cm.words_of(texts, cm.ALNUM, True)
        hit = np.zeros(len(words.hashes), bool)
        places = rows["hits"].flatten()
        if len(places):
            owner = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(rows["hits"]), 0).to_numpy(zero_copy_only=False))
            span, place = (places.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for n in np.unique(span):
                own = span == n
                hit |= wn.covered(len(hit), words.first[owner[own]] + place[own], int(n))
        return {"id": rows["id"], **_row_results(words, hit, [sorted(x or []) for x in rows["items"].to_pylist()])}

    # a key of the row's own content: rows with equal ids and texts have equal answers
    docs = docs.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = docs.select("key", "text").dropDuplicates(["key"])
    met = cm.map_texts(texts, marks_of, "key string, span int, mark bigint").join(windows.select("span", "mark").distinct(), ["span", "mark"])
    met = met.groupBy("key").agg(F.collect_list(F.struct("span", "mark")).alias("met"))
    found = cm.map_texts(texts.join(met, "key"), windows_of, "key string, span int, low bigint, high bigint, place bigint")
    found = found.join(windows.select("span", "low", "high", "item"), ["span", "low", "high"])
    hits = found.groupBy("key").agg(F.collect_set(F.struct("span", "place")).alias("hits"), F.collect_set("item").alias("items"))
    return cm.map_texts(docs.join(hits, "key", "left"), result, f"id {kind}, {SCHEMA}")


def _windows(items: DataFrame, span: int, item_id: str, item_text: str) -> DataFrame:
    return cm.checkpointed(item_windows(items, span, item_id, item_text))


def contamination(
    docs: DataFrame, items: DataFrame, span: int = SPAN, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated -- a row per input row."""
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    windows = _windows(items, span, item_id, item_text)
    way = _in_tasks if windows.count() <= broadcast_windows else _by_joins
    return way(docs, windows, kind).withColumnRenamed("id", doc_id)


def clean(
    docs: DataFrame, items: DataFrame, span: int = SPAN, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """Rows of ``docs`` without any hit, with all their columns."""
    windows = _windows(items, span, item_id, item_text)
    if windows.count() > broadcast_windows:
        own = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
        found = _by_joins(docs.select(own.alias("id"), F.col(text).alias("text")), windows, "string").where("contaminated")
        name = cm.free_name("contaminated_text", docs)
        return docs.join(found.select(F.col("id").alias(name)).distinct(), own == F.col(name), "left_anti")
    index = docs.sparkSession.sparkContext.broadcast(_Index(windows.toArrow()))

    def run(rows, texts):
        words = cm.words_of(texts, cm.ALNUM, True)
        total = np.concatenate([[0], np.cumsum(index.value.hits(words)[0])])[words.first]
        return np.diff(total) == 0

    return cm.filter_texts(docs, run, text)
