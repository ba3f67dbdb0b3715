"""Merkle manifest of a table by sibling-shift self-joins, in DataFrame functions only.

Every row is a leaf.  The leaves of one group (``source``) are the lowest level of a tree; while a level has
more than one node, every ``arity`` consecutive nodes (the last run may be shorter) have one parent, the hash of
their digests.  What remains of each group, in the order of the groups, is the lowest level of one more tree,
whose top is the root of the table.

A level is a table of nodes (tree, idx, n, digest).  Each node computes the places of its siblings, ``idx XOR 1`` in a
binary tree and else its run's beginning plus a shifted slot, and a self-equijoin on (tree, place) for each
shift brings their digests; the rows of slot 0 then hold whole runs and emit the parents.  A key of these
joins has one row, so no group or source is hot in them.  Levels are written beside the checkpoints; the small ones are
broadcast by their file size, as Spark does by itself.  Proofs go down again: a node's path is its own
siblings followed by its parent's path, one equijoin on (tree, parent) a level.

Leaves are numbered without a window over a source: a range partition by (source, doc_id) is written,
rows get their place in it, and partitions (one row each) are summed up.

Defined cases.  A null value is hashed as ``-`` and any other as its UTF-8 length, ``:`` and itself, so a null and an
empty text differ.  A null source is a group of its own and comes first; so does a null doc_id in its
source.  Rows with equal source and doc_id are ordered by their digests, wholly equal rows are leaves of their own.
A null doc_id is never tampered with.  A tree of one leaf has this leaf as its top and no siblings; a proof
without siblings is the hash of nothing.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm import common as cm
from wordloom.llm.tokenids import fresh_path

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
GROUPS_BYTES = 32 << 20   # of group names that may be broadcast
EMPTY = "cast('' as binary)"
NO_PATH = "cast(array() as array<struct<left: binary, right: binary>>)"


def digest(*parts: Column) -> Column:
    """SHA-256 of the concatenated parts, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hexed(c: Column) -> Column:
    """Digests as lowercase hexadecimal text."""
    return F.lower(F.hex(c))


def framed(c: Column) -> Column:
    """A value so that concatenated values can be told apart; null is ``-``."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, f"merkle-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``rows`` with ``at``, their place (from 0) in the order, and ``pid``, the range partition that holds them; equal rows in any order."""
    tied = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))  # many equal rows spread over partitions
    placed = tied.repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").drop("tie").withColumn("at", F.monotonically_increasing_id())
    placed = _written(placed, "order").withColumn("pid", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("pid").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    first = sizes.select("pid", F.coalesce(before, F.lit(0)).alias("first"))
    return placed.join(F.broadcast(first), "pid").withColumn("at", F.col("at") + F.col("first")).drop("first")


def _in_trees(rows: DataFrame) -> DataFrame:
    """Numbered rows with tree (place of the group's first row), idx in it and its size n; joined by partition and group, so no group is hot."""
    parts = cm.checkpointed(rows.groupBy("pid", "key").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first")))
    trees = parts.groupBy("key").agg(F.sum("c").alias("n"), F.min("first").alias("tree"))
    info = cm.checkpointed(parts.select("pid", "key").join(trees, "key"))
    size = info.agg(F.sum(F.octet_length("key") + 32)).first()[0] or 0
    info = F.broadcast(info) if size <= GROUPS_BYTES else info
    return rows.join(info, ["pid", "key"]).withColumn("idx", F.col("at") - F.col("tree")).drop("pid", "at", "key")


def with_siblings(nodes: DataFrame, arity: int = 3) -> DataFrame:
    """``nodes`` (tree, idx, digest and others) with the digests of the run's other nodes, ``left`` and ``right`` of each."""
    slot = F.col("idx") % arity
    others = nodes.select(F.col("tree").alias("of"), F.col("idx").alias("place"), F.col("digest").alias("d"))
    rows, found = nodes, []
    for shift in range(1, arity):
        sibling = F.col("idx").bitwiseXOR(1) if arity == 2 else F.col("idx") - slot + (slot + shift) % arity
        other = others.withColumnsRenamed({"of": f"of{shift}", "place": f"place{shift}", "d": f"d{shift}"})
        rows = rows.join(other, (F.col("tree") == F.col(f"of{shift}")) & (sibling == F.col(f"place{shift}")), "left")
        found.append((shift, F.coalesce(f"d{shift}", F.expr(EMPTY))))
    wrapped = [(shift >= arity - slot, d) for shift, d in found]  # a shift past the run's end is a slot before this one
    left = F.concat(*[F.when(w, d).otherwise(F.expr(EMPTY)) for w, d in wrapped])
    right = F.concat(*[F.when(w, F.expr(EMPTY)).otherwise(d) for w, d in wrapped])
    return rows.select(*nodes.columns, left.alias("left"), right.alias("right"))


def parents(level: DataFrame, arity: int = 3) -> DataFrame:
    """The next level: slot-0 rows hold their whole run."""
    return level.where(F.col("idx") % arity == 0).select(
        "tree", F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("n") / arity).alias("n"),
        digest(hexed(F.col("digest")), hexed(F.col("right"))).alias("digest"))


@dataclass
class Forest:
    """``levels[i]``: the nodes of level i (with siblings) in trees that go on; ``tops``: tree, height, digest."""

    levels: list[DataFrame]
    tops: DataFrame


def build(nodes: DataFrame, arity: int = 3) -> Forest:
    """All levels over ``nodes`` (tree, idx, n, digest; other columns stay in level 0)."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], []
    while True:
        tops.append(nodes.where("n = 1").select("tree", F.lit(len(levels)).alias("height"), "digest"))
        if most <= 1:
            break
        levels.append(_written(with_siblings(nodes.where("n > 1"), arity), f"level{len(levels)}"))
        nodes, most = parents(levels[-1], arity), -(-most // arity)
    return Forest(levels, _written(reduce(DataFrame.unionAll, tops), "tops"))


def paths(levels: list[DataFrame], tops: DataFrame, down_to: int, arity: int = 3) -> DataFrame:
    """tree, idx, path, and tops' other columns, of the nodes of level ``down_to`` and of the tops of that height.

    ``tops``: tree, height, path (what lies above the top); an entry of a path is the digests left and right of it."""
    above = tops.where(F.col("height") == len(levels)).withColumn("idx", F.lit(0).cast("bigint")).drop("height")
    names = above.columns
    for height in range(len(levels) - 1, down_to - 1, -1):
        parent = above.withColumnsRenamed({"tree": "of", "idx": "up", "path": "rest"})
        level = levels[height].select("tree", "idx", "left", "right")
        below = level.join(parent, (F.col("tree") == F.col("of")) & (F.floor(F.col("idx") / arity) == F.col("up")))
        below = below.withColumn("path", F.concat(F.array(F.struct("left", "right")), "rest")).select(names)
        above = _written(below.unionByName(tops.where(F.col("height") == height).withColumn("idx", F.lit(0).cast("bigint")).select(names)), f"paths{height}")
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda acc, e: digest(hexed(e["left"]), hexed(acc), hexed(e["right"])))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", group: str = "source", arity: int = 3,
             tampered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path, given (digests; path: siblings from the leaf to the root).

    ``given`` is the leaf, or where ``when`` holds the leaf with the columns of ``tampered`` put in their places."""
    given = [(tampered or {}).get(f, F.col(f)) for f in fields]
    leaves = docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("")).alias("key"),
        digest(*[framed(F.col(f)) for f in fields]).alias("digest"),
        (F.when(F.coalesce(when, F.lit(False)), digest(*map(framed, given))) if when is not None else F.lit(None).cast("binary")).alias("changed"))
    leaves = _in_trees(numbered(_written(leaves, "leaves"), ["key", "id", "digest"]))
    forest = build(leaves, arity)
    # the groups' tops in the order of their trees are the leaves of the last tree
    subroots = numbered(forest.tops, ["tree"]).drop("pid").withColumnsRenamed({"tree": "group", "at": "idx"})
    n_trees = subroots.count()
    top = build(subroots.withColumns({"tree": F.lit(0).cast("bigint"), "n": F.lit(n_trees).cast("bigint")}), arity)
    root = top.tops.first()
    root = F.lit(root["digest"] if root else None).cast("binary")
    ends = top.tops.select("tree", "height", F.expr(NO_PATH).alias("path"))
    low = subroots.select(F.col("group"), "idx", "height", F.col("digest").alias("subroot"))
    above = paths(top.levels, ends, 0, arity).select(F.col("idx").alias("at"), "path")
    seeds = _written(low.join(above, F.col("idx") == F.col("at")).select(F.col("group").alias("tree"), "height", "path", "subroot"), "seeds")
    up = paths(forest.levels, seeds, 1, arity) if forest.levels else seeds.withColumn("idx", F.lit(0).cast("bigint")).drop("height").limit(0)
    alone = leaves.where("n = 1").join(seeds.drop("height"), "tree").select("id", "digest", "changed", "subroot", "path")
    if not forest.levels:
        rows = alone
    else:
        up = up.withColumnsRenamed({"tree": "of", "idx": "up", "path": "rest"})
        own = forest.levels[0].join(up, (F.col("tree") == F.col("of")) & (F.floor(F.col("idx") / arity) == F.col("up")))
        rows = own.select("id", "digest", "changed", "subroot", F.concat(F.array(F.struct("left", "right")), "rest").alias("path")).unionByName(alone)
    return rows.select(F.col("id").alias(doc_id), F.col("digest").alias("leaf"), "subroot", root.alias("root"), "path", F.coalesce("changed", "digest").alias("given"))


def proof_sha256(path: Column) -> Column:
    """Hash of all siblings of a path, as hexadecimal text."""
    return F.sha2(F.array_join(F.transform(path, lambda e: hexed(F.concat(e["left"], e["right"]))), ""), 256)


def verified(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from ``given``), verified -- of a manifest's rows."""
    rows = rows.withColumn("folded", folded(F.col("given"), F.col("path")))
    return rows.select(
        doc_id, *[hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], proof_sha256(F.col("path")).alias("proof_sha256"),
        hexed(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
