"""Token ids in binary shards with a minimal perfect hash index.

Format of a written folder (all files by Spark's Parquet writer, so a lost task
leaves nothing behind and any store that Spark reaches will do):

``ids``    a row per block: shard, block, first (token of the shard that the block begins
           with), keys and starts of its documents, and ``payload``: the raw ids, little-endian and unsigned, of
           2 bytes each if the vocabulary allows and else 4 (``width``).  A document lies in one block.
``shards`` a row per shard: shard, n_tokens, base (ids of all shards before it).
``index``  a row per index part (keys are dealt by hash): a minimal perfect hash function over the part's
           keys and, for each of its slots, a fingerprint, shard, block, place in the payload and length
           of the key's first document.
``rivals`` a row per further document of a key, dealt over salts; ``repeats`` a row per key that has any: key, salts.

Documents lie in ascending order of their id: the shards are a range partition, each sorted.
A key is looked up by one evaluation of its part's hash function and one comparison of the slot's
fingerprint; the function needs no keys.  It is built level by level: the keys
without a rival for their place in a level's bit array set its bit, the others go on to the next
level; a key's slot is the rank of its bit.

Defined cases.  Null and empty texts are one end id.  Rows with equal ids lie side by side (ordered by a hash of their texts, equal
rows spread over shards) and all are found under their key: the first by its slot, the others by an equijoin on key and salt, so no
task holds all rows of one id.  A null id has a key of its own and comes first.  An empty table gives an empty folder and no
rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm import common as cm
from wordloom.llm import encode
from wordloom.session import ensure_checkpoint_dir

U64 = np.uint64
END_ID = 1
SHARD_BYTES = 64 << 20   # of text
PART_KEYS = 100_000
SALT_ROWS = 50_000       # further documents of a key under one salt
GAMMA = 1.7              # places per key in a level
IDS = "shard int, block int, first bigint, width int, keys array<bigint>, starts array<bigint>, sizes array<bigint>, payload binary"


def key_of(doc_id: Column) -> Column:
    """64-bit key of an id of any type; a null id is not an empty string."""
    return F.xxhash64(doc_id.isNull(), doc_id.cast("string"))


# ---- minimal perfect hash function ------------------------------------------------


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (cm.mix(keys ^ U64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % U64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    """Bit arrays of the levels, one after the other, and the rank before each level."""

    sizes: list[int]
    bits: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = GAMMA) -> PerfectHash:
        """``keys`` are distinct."""
        sizes, levels = [], []
        while len(keys):
            size = max(8, int(len(keys) * gamma)) // 8 * 8 + 8
            at = _place(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            sizes.append(size)
            levels.append(bits)
            keys = keys[~alone]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; of a key that was not built in any slot, or -1."""
        rank = np.concatenate([[0], np.cumsum(self.bits)])
        out, left, base = np.full(len(keys), -1), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + _place(keys[left], level, size)
            set_ = self.bits[at]
            out[left[set_]] = rank[at[set_]]
            left, base = left[~set_], base + size
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (cm.mix(keys + U64(0xD6E8FEB86659FD93)) >> U64(32)).astype(np.uint32)


# ---- writing ----------------------------------------------------------------------


def _by_slice(slices: Iterator[tuple[pa.RecordBatch, pa.Array]], encoder: encode.JsonEncoder) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, sizes) of each slice, encoded in runs of about ``GROUP_BYTES``, so that the encoder meets a word of several slices once."""
    def run():
        ids, sizes = encoder.encode([t for _, texts in held for t in texts])
        at = np.cumsum([len(rows) for rows, _ in held])[:-1]
        first = np.cumsum(sizes) - sizes
        return zip([rows for rows, _ in held], np.split(ids, first[at]), np.split(sizes, at), strict=True)

    held, size = [], 0
    for rows, texts in slices:
        texts = texts.cast(pa.large_binary()).to_pylist()
        n_bytes = sum(map(len, texts))
        if held and size + n_bytes > encode.GROUP_BYTES:
            yield from run()
            held, size = [], 0
        held.append((rows.select(["key"]), texts))
        size += n_bytes
    if held:
        yield from run()


def _encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Blocks of sorted partitions; the partition is the shard."""
    def blocks(batches):
        encoder = encode.json_encoder(tokenizer)
        width = 2 if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else 4
        shard, first = TaskContext.get().partitionId(), 0
        for block, (rows, ids, sizes) in enumerate(_by_slice(cm.slices(batches, "text"), encoder)):
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, end_id)
            sizes = sizes + 1
            starts = first + np.cumsum(sizes) - sizes
            payload = ids.astype(f"<u{width}").tobytes()
            one = np.array([0, len(sizes)])
            yield pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first]), pa.array([width], pa.int32()),
                cm.lists(rows["key"].to_numpy(zero_copy_only=False), one), cm.lists(starts, one), cm.lists(sizes, one), pa.array([payload], pa.binary()),
            ], names=["shard", "block", "first", "width", "keys", "starts", "sizes", "payload"])
            first += len(ids)

    cm.workers_find_package(docs.sparkSession)
    return docs.mapInArrow(blocks, IDS)


def _index_part(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = pdf["key"].to_numpy().view(U64)
    hash_ = PerfectHash.build(keys)
    slot = np.empty(len(keys), np.int64)
    slot[hash_.slots(keys)] = np.arange(len(keys))
    return pd.DataFrame([{
        "part": int(pdf["part"].iloc[0]), "parts": int(pdf["parts"].iloc[0]), "sizes": hash_.sizes, "bits": np.packbits(hash_.bits).tobytes(),
        "fingerprints": fingerprint(keys[slot]).astype("<u4").tobytes(), **{c: pdf[c].to_numpy()[slot].astype(np.int64).tolist() for c in ("shard", "block", "start", "n")},
    }])


INDEX = "part bigint, parts bigint, sizes array<bigint>, bits binary, fingerprints binary, shard array<bigint>, block array<bigint>, start array<bigint>, n array<bigint>"
RIVALS, REPEATS = "key bigint, salt bigint, shard int, block int, start bigint, n bigint", "key bigint, salts bigint"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text",
          shard_bytes: int = SHARD_BYTES, part_keys: int = PART_KEYS) -> None:
    """Write ``docs`` to a new folder ``path`` that driver and executors share."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    n_bytes, n_docs = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(-(-n_bytes // shard_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["id", "h", "tie"]
    tied = docs.withColumn("h", F.xxhash64("text")).withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))  # many equal rows spread over shards
    rows = tied.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    rows = rows.select(key_of(F.col("id")).alias("key"), "text")
    _encoded(rows, tokenizer, end_id).write.option("compression", "zstd").parquet(f"{path}/ids")
    ids = spark.read.parquet(f"{path}/ids").drop("payload")
    totals = ids.groupBy("shard").agg(F.max(F.element_at("starts", -1) + F.element_at("sizes", -1)).alias("n_tokens"))
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row per shard
    totals.withColumn("base", F.coalesce(before, F.lit(0))).write.parquet(f"{path}/shards")
    parts = max(1, -(-n_docs // part_keys))
    place = F.struct("shard", "block", (F.col("e.starts") - F.col("first")).alias("start"), F.col("e.sizes").alias("n"))
    entries = ids.select("shard", "block", "first", F.explode(F.arrays_zip("keys", "starts", "sizes")).alias("e")).select(F.col("e.keys").alias("key"), place.alias("place"))
    firsts = cm.checkpointed(entries.groupBy("key").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("c")))  # combined before the shuffle
    parted = firsts.select(F.pmod("key", F.lit(parts)).alias("part"), F.lit(parts).cast("bigint").alias("parts"), "key", "place.*")
    parted.groupBy("part").applyInPandas(_index_part, INDEX).write.option("compression", "zstd").parquet(f"{path}/index")
    repeated = firsts.where("c > 1").select("key", F.col("place").alias("least"), F.ceil((F.col("c") - 1) / SALT_ROWS).alias("salts"))
    n_repeated = repeated.count()
    repeated.select("key", "salts").write.parquet(f"{path}/repeats")
    # a key with many documents is a row here; the documents' side is read in place, or split by AQE beyond the bound
    rivals = entries.join(cm.small_or_plain(repeated, n_repeated), "key").where("place != least")
    salt = F.pmod(F.xxhash64("place"), "salts")
    rivals.select("key", salt.alias("salt"), "place.*").write.parquet(f"{path}/rivals")


# ---- reading ----------------------------------------------------------------------


def _find(key: tuple, wanted: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    empty = pd.DataFrame({c: np.empty(0, np.int64) for c in ("key", "shard", "block", "start", "n")})
    if not len(wanted) or not len(index):
        return empty
    part = index.iloc[0]
    sizes = [int(s) for s in part["sizes"]]
    hash_ = PerfectHash(sizes, np.unpackbits(np.frombuffer(part["bits"], np.uint8), count=sum(sizes)).astype(bool))
    keys = wanted["key"].to_numpy().view(U64)
    marks = np.frombuffer(part["fingerprints"], "<u4")
    slot = hash_.slots(keys)
    real = np.flatnonzero((slot >= 0) & (marks[slot] == fingerprint(keys)))
    return pd.DataFrame({"key": keys[real].view(np.int64), **{c: np.asarray(part[c])[slot[real]] for c in ("shard", "block", "start", "n")}})


def lookup(spark: SparkSession, path: str, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, shard, block, start (place in the block's payload), n -- of each distinct id of ``ids`` that the folder holds."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    parts = (index.agg(F.max("parts")).first()[0]) or 1
    wanted = ids.select(F.col(doc_id).alias("id")).distinct().withColumn("key", key_of(F.col("id")))
    keyed = wanted.withColumn("part", F.pmod("key", F.lit(parts)))
    cm.workers_find_package(spark)
    found = keyed.select("part", "key").groupBy("part").cogroup(index.groupBy("part")).applyInPandas(_find, "key bigint, shard bigint, block bigint, start bigint, n bigint")
    places = ("shard", "block", "start", "n")
    firsts = found.join(wanted, "key").select("id", *places)
    repeats = spark.read.schema(REPEATS).parquet(f"{path}/repeats")
    if not repeats.isEmpty():
        salted = wanted.join(repeats, "key").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
        rivals = spark.read.schema(RIVALS).parquet(f"{path}/rivals").join(salted, ["key", "salt"])
        firsts = firsts.unionByName(rivals.select("id", *places))
    return firsts.withColumnRenamed("id", doc_id)


def _reader(kind: pa.DataType, value, value_type: pa.DataType):
    """Apply ``value(ids)`` to every looked up document of a block."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["payload"], f"<u{row['width']}")
                docs = row["docs"]
                got = [value(ids[d["start"]: d["start"] + d["n"]]) for d in docs]
                yield pa.RecordBatch.from_arrays([
                    pa.array([d["id"] for d in docs], kind), pa.array([row["base"] + row["first"] + d["start"] for d in docs], pa.int64()),
                    pa.array([d["n"] for d in docs], pa.int64()), pa.array(got, value_type)], names=["id", "start", "n_tokens", "value"])

    return run


def read(spark: SparkSession, path: str, found: DataFrame, value, value_type: str, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start (ids before it in the folder), n_tokens, value: ``value(ids)`` of each place that ``lookup`` found."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kind = found.schema[doc_id].dataType
    # a block is bounded (one slice of texts), and so is the list of its documents
    docs = found.groupBy("shard", "block").agg(F.collect_list(F.struct(F.col(doc_id).alias("id"), "start", "n")).alias("docs"))
    blocks = spark.read.schema(IDS).parquet(f"{path}/ids").select("shard", "block", "first", "width", "payload")
    shards = spark.read.schema("shard int, base bigint").parquet(f"{path}/shards")
    rows = blocks.join(docs.join(shards, "shard"), ["shard", "block"]).select("first", "width", "payload", "base", "docs")
    out = StructType.fromDDL(f"v {value_type}")["v"].dataType
    cm.workers_find_package(spark)
    got = rows.mapInArrow(_reader(to_arrow_type(kind), value, to_arrow_type(out)), f"id {kind.simpleString()}, start bigint, n_tokens bigint, value {value_type}")
    return got.withColumnRenamed("id", doc_id)


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
