"""Placement of documents on shards by a permutation-filled lookup table.

The table has a prime number of slots.  Every shard has its own order of
preference over all slots, (offset + i * skip) modulo the size with offset and
skip hashed from its name; as the size is prime the order is a permutation.
Shards take turns, each claiming the first free slot of its order (a shard of weight w has w
turns in a round), until the table is full.  Shards so hold equal numbers of slots to
within a turn, and when a shard leaves or joins most slots stay with their
shard.  The table is a bounded parameter (``slots`` rows), so it is broadcast
whatever the size of the data: a document's slot is its key's hash modulo
the size, and its shard one lookup.

A key that holds more than a shard's even part of all rows can be split
(``split_hot``): its rows are dealt over as many sub-keys as it has such parts,
by a hash of id and text.

Defined cases.  A null key takes its row's text hash as key (null text: the hash of the
empty text), so null keys don't meet on one shard.  Repeated rows go to the same shard.  An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm import common as cm

SLOTS = 65_537  # prime
MAX_SHARDS_PER_SLOT = 1 / 100


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}:{name}".encode(), digest_size=8).digest(), "little")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Mapping[str, int], slots: int = SLOTS) -> np.ndarray:
    """Shard number (in the order of ``shards``) of every slot; ``shards`` maps names to whole weights."""
    if not is_prime(slots):
        raise ValueError(f"{slots} slots: the number must be prime")
    if not shards or len(shards) > slots * MAX_SHARDS_PER_SLOT or min(shards.values()) < 1:
        raise ValueError(f"{len(shards)} shards: from 1 to {int(slots * MAX_SHARDS_PER_SLOT)} of weight 1 or more for {slots} slots")
    offset = [_hash(s, "offset") % slots for s in shards]
    skip = [_hash(s, "skip") % (slots - 1) + 1 for s in shards]
    weights, tried = list(shards.values()), [0] * len(shards)
    table, free = [-1] * slots, slots
    while True:
        for i, weight in enumerate(weights):
            for _ in range(weight):
                at = (offset[i] + tried[i] * skip[i]) % slots
                while table[at] >= 0:
                    tried[i] += 1
                    at = (offset[i] + tried[i] * skip[i]) % slots
                table[at] = i
                tried[i] += 1
                free -= 1
                if not free:
                    return np.array(table)


def placed(
    docs: DataFrame, shards: Mapping[str, int], key: str = "doc_id", doc_id: str = "doc_id", text: str = "text",
    slots: int = SLOTS, split_hot: bool = False,
) -> DataFrame:
    """All columns of ``docs`` as ``row``, with ``slot`` and ``shard`` (name)."""
    spark = docs.sparkSession
    names = list(shards)
    owners = spark.createDataFrame([(i, names[s]) for i, s in enumerate(lookup_table(shards, slots).tolist())], "slot bigint, shard string")
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("string"))).otherwise(own).alias("key"), F.xxhash64(F.col(doc_id), own).alias("own"))
    if split_hot:
        counts = cm.checkpointed(rows.groupBy("key").count())
        total = counts.agg(F.sum("count")).first()[0] or 0
        hot = counts.where(F.col("count") * len(shards) > total).select("key", F.ceil(F.col("count") * len(shards) / F.lit(max(total, 1))).alias("parts"))
        # at most as many hot keys as shards
        rows = rows.join(F.broadcast(hot), "key", "left").withColumn(
            "key", F.when(F.col("parts").isNotNull(), F.xxhash64("key", F.pmod("own", "parts"))).otherwise(F.col("key")))
    return rows.withColumn("slot", F.pmod("key", F.lit(slots))).join(F.broadcast(owners), "slot").select("row", "slot", "shard")


def write_shards(docs: DataFrame, shards: Mapping[str, int], path: str, **options) -> None:
    """One folder ``shard=<name>`` of Parquet for each shard that has rows; large shards in several files."""
    rows = placed(docs, shards, **options)
    rows.select("row.*", F.col("shard")).write.partitionBy("shard").parquet(path)
