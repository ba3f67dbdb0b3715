"""Document fingerprints: MinHash signatures of word shingles, their likeness, and near copies by banding.

A text's set are its distinct shingles of five lower-cased words.  A permutation is a universal hash
``(a * x + b) mod 2**64`` with odd ``a``; the signature keeps 16 mixed bits of the minimum under each of
``bands * rows`` permutations, computed for a slice of texts at once in numpy.  The fingerprint is the
signature in hexadecimal, and the likeness of two fingerprints is the share of equal places, an estimate of
the Jaccard similarity of the sets with a standard error of at most 0.06 (64 places).

``fingerprinted`` puts every document beside the next one (descending ids): a range partition by id is
sorted and read as a stream, so a task holds a batch of texts; the texts cross that one shuffle packed (zstd).  The last
document of each partition meets the first one of the next in a join of one row per partition.

``near_copies`` cuts signatures into bands.  Documents that share a band are joined in Spark, and their pairs
verified on the full sets.  Documents with equal sets are one node; every node is paired with the smallest and the
largest node under each of its bands, links are closed to classes, and bands whose nodes are still in several
classes have their other pairs checked in blocks (``minhash``), so no group's pairs are listed.  A pair at
exactly the threshold 0.8 that no third document links shares no band with probability 2e-4 (0.85: 7e-6).

Defined cases.  A null text is an empty one.  Texts without words have one common fingerprint, with all bits set,
and are near copies of nothing.  A text of fewer words than a shingle is one shingle.  Rows with equal
ids follow one another by a hash of their texts, null ids come last.  After the last row comes the first; a
table of one row is its own next.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm import common as cm
from wordloom.llm import minhash
from wordloom.llm.components import connect
from wordloom.llm.tokenids import fresh_path

U64 = np.uint64


@dataclass(frozen=True)
class Prints:
    shingle: int = 5
    percent: int = 80   # near copies: 100 * intersection >= percent * union
    bands: int = 16
    rows: int = 4       # places of a band

    @property
    def places(self) -> int:
        return self.bands * self.rows


@cache
def permutations(places: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of the universal hashes, fixed by their number."""
    seeds = cm.mix(np.arange(1, 2 * places + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return seeds[::2] | U64(1), seeds[1::2]


def signatures(grams: np.ndarray, first: np.ndarray, places: int) -> np.ndarray:
    """16 bits of the minimum under each permutation, a row for each set ``grams[first[r]:first[r+1]]``; all bits for an empty set."""
    factors, addends = permutations(places)
    full = np.flatnonzero(np.diff(first))
    out = np.full((len(first) - 1, places), 0xFFFF, "<u2")
    if len(full):
        low = np.empty((places, len(full)), U64)
        for i in range(places):
            h = grams * factors[i]
            h += addends[i]
            low[i] = np.minimum.reduceat(h, first[full])
        out[full] = (cm.mix(low) >> U64(48)).astype("<u2").T
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places of two arrays of signatures."""
    return (a == b).mean(axis=1)


def signed(texts: list[str], p: Prints) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Signatures, set sizes, and 16 bytes that stand for the set, of each text."""
    grams, first = minhash.shingles(cm.words_of(pa.array(texts, pa.large_string()), cm.SPACED, True), p.shingle)
    return signatures(grams, first, p.places), np.diff(first), minhash.node_ids(grams, first)


def edit(text: str, following: str) -> str:
    """The last half (floor) of the characters replaced by as many first ones (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


ROWS = "n_chars bigint, mark bigint, n bigint, node binary, fp binary, edited_sha256 string, edited_fp binary, near_edited double, near_next double"


def _pack(text: str) -> bytes:
    raw = text.encode("utf-8", "replace")
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(packed: bytes) -> str:
    size = int.from_bytes(packed[:8], "little")
    return pa.decompress(packed[8:], size, "zstd", asbytes=True).decode("utf-8", "replace") if size else ""


def _packed(docs: DataFrame) -> DataFrame:
    def run(rows, texts):
        raw = texts.cast(pa.large_binary()).to_pylist()
        return {"id": rows["id"], "mark": rows["mark"], "tie": rows["tie"], "packed": [_pack(t.decode("utf-8", "replace")) for t in raw]}

    return cm.map_texts(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, mark bigint, tie bigint, packed binary")


def _runs(sizes: list[int], limit: int) -> Iterator[slice]:
    """Neighbouring rows of together about ``limit`` bytes."""
    at = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield slice(at, i)
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield slice(at, len(sizes))


def _edited(rows: list[dict], texts: list[str], fps: np.ndarray, p: Prints) -> list[dict]:
    """What follows from each row's text and the next one's (``texts`` and ``fps`` hold one more)."""
    made = [edit(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    edited_fps, _, _ = signed(made, p)
    near = likeness(fps[:-1], edited_fps), likeness(fps[:-1], fps[1:])
    return [r | {"edited_sha256": hashlib.sha256(t.encode()).hexdigest(), "edited_fp": f.tobytes(), "near_edited": float(e), "near_next": float(n)}
            for r, t, f, e, n in zip(rows, made, edited_fps, *near, strict=True)]


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _stream(p: Prints, schema: pa.Schema):
    """Rows of a sorted partition, each beside the next; the partition's first text as ``head`` and its last one as ``tail``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, text, fp = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            for at in _runs([int.from_bytes(x[:8], "little") for x in batch["packed"].to_pylist()], cm.SLICE_BYTES):
                part = batch.slice(at.start, at.stop - at.start)
                texts = [_unpack(x) for x in part["packed"].to_pylist()]
                fps, sizes, nodes = signed(texts, p)
                rows = [{"id": i, "mark": m, "n_chars": len(t), "n": int(n), "node": node, "fp": f.tobytes(), "pid": pid, "head": None, "tail": None}
                        for i, m, t, n, node, f in zip(part["id"].to_pylist(), part["mark"].to_pylist(), texts, sizes, nodes.to_pylist(), fps, strict=True)]
                if last is None:
                    rows[0]["head"] = part["packed"][0].as_py()
                else:
                    rows, texts, fps = [last, *rows], [text, *texts], np.concatenate([fp[None], fps])
                last, text, fp = rows[-1], texts[-1], fps[-1]
                if len(rows) > 1:
                    yield _batch(_edited(rows[:-1], texts, fps, p), schema)
        if last is not None:
            yield _batch([last | {"tail": _pack(text)}], schema)
        pa.default_memory_pool().release_unused()

    return run


def _close(p: Prints, schema: pa.Schema):
    """The last rows of partitions, beside the first text of the next one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts = [_unpack(row.pop("tail")), _unpack(row.pop("following"))]
                fps, _, _ = signed(texts, p)
                yield _batch(_edited([row], texts, fps, p), schema)

    return run


def fingerprinted(docs: DataFrame, p: Prints = Prints(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_chars, mark (hash of the text), n (set size), node (of the set), fp, and edited_sha256, edited_fp, near_edited, near_next with respect to the next document."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    cm.workers_find_package(spark)
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"),
                       F.xxhash64(F.monotonically_increasing_id()).alias("tie"))  # many equal rows spread over partitions
    order = [F.desc_nulls_last("id"), F.col("mark"), F.col("tie")]
    kind = docs.schema["id"].dataType.simpleString()
    done, seen = f"id {kind}, {ROWS}", f"id {kind}, {ROWS}, pid int, head binary, tail binary"
    arrow = [to_arrow_schema(StructType.fromDDL(s)) for s in (done, seen)]
    path = fresh_path(spark, "fingerprints")
    _packed(docs).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream(p, arrow[1]), seen).write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(seen).parquet(path)
    parts = rows.where("tail is not null").select("pid")  # one row per partition
    every = Window.orderBy("pid")
    follows = parts.select("pid", F.coalesce(F.lead("pid").over(every), F.first("pid").over(every)).alias("follower"))
    heads = rows.where("head is not null").select(F.col("pid").alias("follower"), F.col("head").alias("following"))
    names = StructType.fromDDL(done).fieldNames()
    tails = rows.where("tail is not null").join(follows, "pid").join(heads, "follower").select(*names, "tail", "following")
    return rows.where("tail is null").select(names).unionByName(tails.mapInArrow(_close(p, arrow[0]), done))


def band_keys(fp: Column, p: Prints) -> Column:
    """A key for each band of a signature."""
    width = 2 * p.rows
    return F.array(*[F.xxhash64(F.lit(b), F.substring(fp, 1 + b * width, width)) for b in range(p.bands)])


def near_copies(prints: DataFrame, docs: DataFrame, p: Prints = Prints(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """node, class_node (of the least node linked) -- of every node that has links; ``prints``: node, mark, n, fp of ``docs``."""
    same = minhash.NearDup(shingle=p.shingle, percent=p.percent)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"))
    nodes = prints.where("n > 0").select("node", "mark", "n", "fp")
    keyed = nodes.select("node", "n", F.explode(band_keys(F.col("fp"), p)).alias("key"))
    ends = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    keyed = cm.checkpointed(keyed.join(ends, "key").distinct())
    sizes = nodes.select(F.col("node").alias("pivot"), F.col("n").alias("m")).distinct()
    pairs = keyed.select("node", "n", F.explode(F.array("lo", "hi")).alias("pivot")).where("node != pivot").distinct().join(sizes, "pivot")
    pairs = cm.checkpointed(pairs.where(100 * F.least("n", "m") >= p.percent * F.greatest("n", "m")).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct())
    marks = nodes.groupBy("node").agg(F.min("mark").alias("mark"))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(marks, "node").select("mark").distinct()
    sets = minhash._sets(texts.join(cm.small_or_plain(needed, needed.count()), "mark", "left_semi"), same)
    links = cm.checkpointed(minhash._confirmed(pairs, sets, same))
    comps = connect(links)
    more = minhash._leftover_links(keyed.select("key", "node", "n"), comps, marks, texts, same)
    comps = connect(links.unionByName(more)) if more is not None else comps
    return comps.withColumnRenamed("comp", "class_node")


def with_classes(docs: DataFrame, p: Prints = Prints(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``fingerprinted`` with doc_id for id, and class_id: the smallest id among the document's near copies (its own without any)."""
    rows = fingerprinted(docs, p, doc_id, text)
    classes = near_copies(rows, docs, p, doc_id, text)
    per_node = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("c"))
    joined = per_node.join(classes, "node", "left").withColumn("class", F.coalesce("class_node", "node"))
    least = joined.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("c").alias("members")).where("members > 1")
    several = cm.checkpointed(joined.select("node", "class").join(least, "class").select("node", "class_id"))
    out = rows.join(cm.small_or_plain(several, several.count()), "node", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    return out.withColumnRenamed("id", doc_id)
