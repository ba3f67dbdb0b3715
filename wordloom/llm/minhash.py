"""MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its distinct word shingles.  Its signature has
``chunks * width`` minimum hashes of ``bits`` bits; the distance of two
signatures is the number of places where they differ (Hamming), which for two
sets of Jaccard similarity J is a draw of ``chunks * width`` places at rate
1 - J.  The signature is cut into ``chunks`` chunks of ``width`` places.  If two
signatures differ in at most ``chunks * (errors + 1) - 1`` places, then by the
pigeonhole principle some chunk differs in at most ``errors`` places; every
way to leave ``errors`` places of a chunk out is one index key, so such a pair
meets under a key for certain.  With the defaults (6 chunks of 4, one error)
that is every pair at distance 11 of 24 or less; a pair of similarity 0.85
escapes all six chunks with probability 2e-6 and of 0.8 with 4e-5.

Pairs that meet are confirmed on their full sets.  No step lists all pairs of a
group:

1. Documents with equal sets are one node (16 bytes of hash over the set).
2. Every node is paired with the smallest and the largest node under each of
   its keys; pairs are confirmed, and links are closed to components.
3. A key whose nodes are still in several components has its remaining pairs
   checked in tasks: the nodes outside its largest component against all of
   its nodes, in blocks of bounded size.  A block pair returns only links that
   join two components, fewer than it has nodes.  After that no unchecked pair
   under any key crosses two components, so no link is lost.

Defined cases.  Null, empty and wordless texts have no shingles, are linked
with nothing and kept.  A text of fewer words than a shingle is one shingle.
Repeated rows are one node and all get its component; a null id never
wins over an id and stands for itself only if the group has no other.  An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import common as cm
from wordloom.llm.components import connect

U64 = np.uint64


@dataclass(frozen=True)
class NearDup:
    shingle: int = 5
    percent: int = 80            # link if 100 * intersection >= percent * union
    chunks: int = 6
    width: int = 4
    errors: int = 1
    bits: int = 32
    block_shingles: int = 200_000  # set elements on one side of a block pair
    block_nodes: int = 2000        # nodes on one side of a block pair


def shingles(words: cm.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted in a row, and their row boundaries."""
    n = len(words.first) - 1
    at, grams = words.ngrams(k)
    rows = np.searchsorted(words.first, at, "right") - 1
    size = np.diff(words.first)
    for r in np.flatnonzero((size > 0) & (size < k)):  # the whole sequence as one
        short = cm.Words(words.data, words.starts, words.ends, words.hashes[words.first[r]: words.first[r + 1]], np.array([0, size[r]]))
        rows, grams = np.append(rows, r), np.append(grams, short.ngrams(int(size[r]))[1] + U64(size[r]))
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    rows, grams = rows[new], grams[new]
    return grams, np.searchsorted(rows, np.arange(n + 1))


def node_ids(grams: np.ndarray, first: np.ndarray) -> pa.Array:
    """16 bytes for each set: two sums of independent hashes of its elements."""
    total = np.zeros((2, len(grams) + 1), U64)
    for i, seed in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        np.cumsum(cm.mix(grams ^ U64(seed)), out=total[i, 1:])
    sums = (total[:, first[1:]] - total[:, first[:-1]]).T
    return cm.binaries(sums, len(first) - 1, 16)


def signatures(grams: np.ndarray, first: np.ndarray, p: NearDup) -> np.ndarray:
    """(rows with shingles, chunks * width) minimum hashes, cut to ``bits`` bits."""
    at = first[:-1][np.diff(first) > 0]
    out = np.empty((len(at), p.chunks * p.width), U64)
    seeds = cm.mix(np.arange(1, 2 * out.shape[1] + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    for i in range(out.shape[1]):
        h = grams * seeds[2 * i]
        h ^= h >> U64(32)
        h *= seeds[2 * i + 1]
        out[:, i] = np.minimum.reduceat(h, at) if len(at) else 0
    return cm.mix(out) & U64((1 << p.bits) - 1)


def index_keys(signature: np.ndarray, p: NearDup) -> np.ndarray:
    """Keys of each row: for every chunk, every choice of ``errors`` places to leave out."""
    keys = []
    for c in range(p.chunks):
        part = signature[:, c * p.width: (c + 1) * p.width]
        for i, keep in enumerate(combinations(range(p.width), p.width - p.errors)):
            h = np.full(len(part), 1 + i + 1000 * c, U64)
            for j in keep:
                h = cm.mix(h * U64(0x9E3779B97F4A7C15) + part[:, j])
            keys.append(h)
    return np.stack(keys, 1) if len(signature) else np.empty((0, 1), U64)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("mark"))


def _signed(docs: DataFrame, p: NearDup) -> DataFrame:
    def sign(rows, texts):
        grams, first = shingles(cm.words_of(texts, cm.SPACED, True), p.shingle)
        sizes = np.diff(first)
        keys = index_keys(signatures(grams, first, p), p)
        bounds = np.concatenate([[0], np.cumsum(np.where(sizes > 0, keys.shape[1], 0))])
        return {"id": rows["id"], "mark": rows["mark"], "n": sizes, "node": node_ids(grams, first), "keys": cm.lists(keys.ravel(), bounds)}

    kind = docs.schema["id"].dataType.simpleString()
    return cm.map_texts(docs, sign, f"id {kind}, mark bigint, n bigint, node binary, keys array<bigint>")


def _sets(docs: DataFrame, p: NearDup) -> DataFrame:
    def sets(rows, texts):
        grams, first = shingles(cm.words_of(texts, cm.SPACED, True), p.shingle)
        return {"node": node_ids(grams, first), "grams": cm.lists(grams, first)}

    return cm.map_texts(docs, sets, "node binary, grams array<bigint>").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    a, b = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    common = F.size(F.array_intersect("ga", "gb"))
    similar = 100 * common >= p.percent * (F.size("ga") + F.size("gb") - common)
    return pairs.select("a", "b").join(a, "a").join(b, "b").where(similar).select("a", "b")


def _joining_links(group: pd.DataFrame, p: NearDup) -> pd.DataFrame:
    """Links of one block pair that join components, by counting common elements."""
    parent = {c: c for c in group["comp"]}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out, columns = [], 2048
    outer, inner = group[group["outer"]], group[~group["outer"]]
    if len(outer) and len(inner):
        sizes = [np.array([len(g) for g in side["grams"]]) for side in (outer, inner)]
        elements = [np.concatenate(list(side["grams"])) for side in (outer, inner)]
        shared = np.intersect1d(*elements)
        places = []
        for e, n in zip(elements, sizes, strict=True):
            place = np.searchsorted(shared, e)
            hit = (place < len(shared)) & (shared[np.minimum(place, len(shared) - 1)] == e) if len(shared) else np.zeros(len(e), bool)
            places.append((np.repeat(np.arange(len(n)), n)[hit], place[hit]))
        common = np.zeros((len(outer), len(inner)), np.float32)
        for at in range(0, len(shared), columns):
            sides = []
            for (row, place), n in zip(places, sizes, strict=True):
                m = np.zeros((len(n), columns), np.float32)
                here = (place >= at) & (place < at + columns)
                m[row[here], place[here] - at] = 1
                sides.append(m)
            common += sides[0] @ sides[1].T
        union = sizes[0][:, None] + sizes[1][None, :] - common
        comps = outer["comp"].to_numpy(), inner["comp"].to_numpy()
        names = outer["node"].to_numpy(), inner["node"].to_numpy()
        for i, j in zip(*np.nonzero(100 * common >= p.percent * union), strict=True):
            x, y = root(comps[0][i]), root(comps[1][j])
            if x != y:
                parent[x] = y
                out.append((names[0][i], names[1][j]))
    return pd.DataFrame(out, columns=["a", "b"])


def _leftover_links(keyed: DataFrame, comps: DataFrame, nodes: DataFrame, docs: DataFrame, p: NearDup) -> DataFrame | None:
    """Links between components among pairs that the star of a key did not check; None if there are no such keys."""
    held = keyed.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    per_comp = held.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    per_key = per_comp.groupBy("key").agg(
        F.sum("c").alias("members"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("c", "s", "comp")).alias("main"), F.sum("s").alias("total"),
    ).where("members > 3 and comps > 1")  # of up to three nodes the star has checked every pair

    def blocks(elements, members):
        return F.greatest(F.ceil(elements / p.block_shingles), F.ceil(members / p.block_nodes))

    open_rows = cm.checkpointed(held.join(per_key, "key").select(
        "key", "node", "comp", (F.col("comp") != F.col("main.comp")).alias("outer"),
        blocks(F.col("total"), F.col("members")).alias("inner_blocks"),
        blocks(F.col("total") - F.col("main.s"), F.col("members") - F.col("main.c")).alias("outer_blocks"),
    ))
    if open_rows.isEmpty():
        return None
    needed = open_rows.select("node").distinct().join(nodes.select("node", "mark"), "node").select("mark").distinct()
    sets = _sets(docs.join(cm.small_or_plain(needed, needed.count()), "mark", "left_semi"), p)
    spread = F.xxhash64("node", F.lit(7))
    inner = open_rows.select(
        "key", "node", "comp", F.lit(False).alias("outer"), F.pmod(spread, "inner_blocks").alias("i"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("outer_blocks") - 1)).alias("j"))
    outer = open_rows.where("outer").select(
        "key", "node", "comp", F.lit(True).alias("outer"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("inner_blocks") - 1)).alias("i"), F.pmod(spread, "outer_blocks").alias("j"))
    rows = inner.unionByName(outer).join(sets, "node")
    return rows.groupBy("key", "i", "j").applyInPandas(lambda g: _joining_links(g, p), "a binary, b binary").distinct()


def _grouped(docs: DataFrame, p: NearDup) -> DataFrame:
    """id, mark, n, comp (null without shingles) of each row of ``_texts``."""
    signed = cm.checkpointed(_signed(docs, p))
    nodes = signed.where("n > 0").groupBy("node").agg(F.min("mark").alias("mark"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    keyed = nodes.select("node", "n", F.explode(F.array_distinct("keys")).alias("key"))
    ends = keyed.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lo"), F.max(F.struct("node", "n")).alias("hi")).where("lo.node < hi.node")
    keyed = cm.checkpointed(keyed.join(ends, "key"))
    pairs = cm.checkpointed(
        keyed.select("node", "n", F.explode(F.array("lo", "hi")).alias("pivot"))
        .where((F.col("pivot.node") != F.col("node")) & (100 * F.least("n", "pivot.n") >= p.percent * F.greatest("n", "pivot.n")))
        .select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")).distinct()
    )
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "mark"), "node").select("mark").distinct()
    sets = _sets(docs.join(cm.small_or_plain(needed, needed.count()), "mark", "left_semi"), p)
    links = cm.checkpointed(_confirmed(pairs, sets, p))
    comps = connect(links)
    more = _leftover_links(keyed.select("key", "node", "n"), comps, nodes, docs, p)
    if more is not None:
        comps = connect(links.unionByName(more))
    return signed.select("id", "mark", "n", "node").join(comps, "node", "left").select(
        "id", "mark", "n", F.when(F.col("n") > 0, F.coalesce("comp", "node")).alias("comp"))


def near_duplicates(docs: DataFrame, p: NearDup = NearDup(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id linked), kept -- a row per input row."""
    rows = _grouped(_texts(docs, doc_id, text), p)
    least = rows.where("comp is not null").groupBy("comp").agg(F.min("id").alias("least"))
    return rows.join(least, "comp", "left").select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.col(doc_id).eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, p: NearDup = NearDup(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates (the smallest id, then the smallest text hash) and all wordless rows."""
    rows = cm.checkpointed(_grouped(_texts(docs, doc_id, text), p).where("comp is not null"))
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "mark")).alias("first"))
    rows = rows.join(first, "comp").withColumn("stays", F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark")))
    gone = cm.checkpointed(rows.where(~F.col("stays")).select("id", "mark").distinct())
    repeated = cm.checkpointed(rows.where("stays").groupBy("id", "mark").count().where("count > 1").select("id", "mark"))
    mark = F.xxhash64(F.col(text))
    same = lambda t: docs[doc_id].eqNullSafe(t["id"]) & (F.xxhash64(docs[text]) == t["mark"])
    kept = docs.join(cm.small_or_plain(gone, gone.count()), same(gone), "left_anti")
    if repeated.isEmpty():
        return kept
    again = cm.small_or_plain(repeated, repeated.count())
    alone = kept.join(again, same(repeated), "left_anti")
    own = cm.free_name("mark", docs)
    twice = kept.join(again, same(repeated), "left_semi").withColumn(own, mark).dropDuplicates([doc_id, own]).drop(own)
    return alone.unionByName(twice)
