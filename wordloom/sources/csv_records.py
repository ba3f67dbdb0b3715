"""Quoted CSV files read in blocks: records that span lines, found in parallel (S1), with ids in file order.

A quoted field may hold newlines, so a line alone does not say whether it begins
a record.  A block of lines can begin in two states only: outside quotes (at the
beginning of a record) or inside a quoted field.

1. Each block of lines is read once and answers, for either state, how it ends
   and how many records begin in it: one small row per block.
2. The blocks of a file are put in order and the answers composed: now every
   block knows its state and the number of records before it.  This table has a
   row per block (128 MB of input) and is broadcast; its rows are counted.
3. Each block is read again and cut into records, which are written beside the
   checkpoints.  Whole records go straight to the parser; only the pieces of a
   record that crosses a block's end are grouped by record and put together.

Parsing is Spark's own (``from_csv``), with the options of a plain scan.  The
quoting rules are those of that parser: a quote opens a quoted field only right
after a separator or a newline, two quotes inside stand for one, and after the
closing quote everything up to the next separator belongs to the field.

Ids: the number of records before, in the files ordered by path (headers and
empty lines do not count), so they follow the order of the concatenated files.

Defined cases.  Lines end with ``\\n`` or ``\\r\\n``; a ``\\r\\n`` inside quotes is kept.
Empty lines outside quotes are skipped.  A file without records gives no rows; a
quote that is never closed makes the rest of its file one record.  Compressed
files are one block.  Both reads must cut the files alike: if Spark's cores or
split settings change in between and move the blocks, the scan raises.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.session import cut_lineage, ensure_checkpoint_dir, workers_find_package

MAX_BLOCKS = 1_000_000  # rows of the broadcast table of blocks: 128 TB in blocks of 128 MB
OUTSIDE, INSIDE = 0, 1
# After an opening quote: text and doubled quotes; then the closing quote with the rest of its field.
_CONTENT = r'[^"]*+(?:""[^"]*+)*+'
_CLOSED = rf'{_CONTENT}"[^,]*+'
_FIELD = rf'(?:"{_CLOSED}|[^",][^,]*+|)'
#: A line that begins a record and ends inside a quoted field.
OPENS = re.compile(rf'(?:{_FIELD},)*+"{_CONTENT}')
#: A line that begins inside a quoted field and ends inside it, or inside a later one.
STAYS = re.compile(_CONTENT)
STAYS_LATER = re.compile(rf'{_CLOSED},(?:{_FIELD},)*+"{_CONTENT}')


def end_state(line: str, state: int) -> int:
    """The state after a line."""
    if state == OUTSIDE:
        return INSIDE if OPENS.fullmatch(line) else OUTSIDE
    return INSIDE if STAYS.fullmatch(line) or STAYS_LATER.fullmatch(line) else OUTSIDE


def _file(path: Column) -> Column:
    """A hash of a file's path; schemes are spelled with one or three slashes by different readers."""
    return F.xxhash64(F.ltrim(F.substring_index(path, ":/", -1), F.lit("/")))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file (a hash of its path), block, line -- the physical lines; a task reads the lines that begin in its block, in order."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(_file(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _paths(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, path: a row per file."""
    names = spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "path string")
    return names.select(_file(F.col("path")).alias("file"), "path")


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of neighbouring rows with equal keys."""
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return zip(cuts, cuts[1:], strict=False) if len(keys) else iter(())


def _without_mark(lines: pa.Array) -> pa.Array:
    """A file's first lines without a byte order mark."""
    first = lines[0].as_py()
    return pa.concat_arrays([pa.array([first[1:]], lines.type), lines.slice(1)]) if first.startswith("\ufeff") else lines


class _Lines:
    """Lines of one block, of which only those with a quote can change the state."""

    def __init__(self, lines: pa.Array):
        self.lines = lines
        self.quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
        self.texts = lines.take(pa.array(self.quoted)).to_pylist()
        empty = pc.or_(pc.equal(lines, ""), pc.equal(lines, "\r"))
        self.filled = ~empty.to_numpy(zero_copy_only=False)

    def inside(self, state: int) -> np.ndarray:
        """Whether each line begins inside a quoted field, and at last whether the lines end so."""
        flips = np.zeros(len(self.lines) + 1, np.int8)
        flips[0] = now = state
        for at, text in zip(self.quoted.tolist(), self.texts, strict=True):
            after = end_state(text, now)
            if after != now:
                flips[at + 1] ^= 1
                now = after
        return np.bitwise_xor.accumulate(flips).astype(bool)


_SUMMARY = {"file": pa.int64(), "block": pa.int64(), "end0": pa.int32(), "end1": pa.int32(), "records0": pa.int64(), "records1": pa.int64()}
_STATES = "file bigint, block bigint, state int, ending int, before bigint, records bigint"
_PIECES = {"id": pa.int64(), "number": pa.int64(), "whole": pa.bool_(), "text": pa.string()}


def _ddl(columns: dict[str, pa.DataType]) -> str:
    names = {pa.string(): "string", pa.int64(): "bigint", pa.int32(): "int", pa.bool_(): "boolean"}
    return ", ".join(f"{name} {names[kind]}" for name, kind in columns.items())


def _batch(values: list, columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, kind) for v, kind in zip(values, columns.values(), strict=True)], names=list(columns))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and either state at its beginning: the state at its end, and how many records begin in it."""
    totals: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        files, places = batch["file"].to_numpy(), batch["block"].to_numpy()
        for begin, end in _runs(np.rec.fromarrays([files, places])):
            key = batch["file"][begin].as_py(), batch["block"][begin].as_py()
            fresh = key not in totals
            t = totals.setdefault(key, [OUTSIDE, INSIDE, 0, 0])
            part = batch["line"].slice(begin, end - begin)
            lines = _Lines(_without_mark(part) if fresh and key[1] == 0 else part)
            for state in {t[0], t[1]}:
                inside = lines.inside(state)
                for k in (0, 1):
                    if t[k] == state:
                        t[2 + k] += int((lines.filled & ~inside[:-1]).sum())
                        t[k] = (int(inside[-1]),)  # set after both states are read
            t[0], t[1] = (x[0] for x in t[:2])
    rows = [(*key, *t) for key, t in totals.items()]
    yield _batch([list(c) for c in zip(*rows, strict=True)] if rows else [[]] * len(_SUMMARY), _SUMMARY)


def _composed(blocks: pd.DataFrame) -> pd.DataFrame:
    """One file's blocks in order: the state and the number of records before each."""
    blocks = blocks.sort_values("block")
    state, before, out = OUTSIDE, 0, []
    for b in blocks.itertuples(index=False):
        n = b.records1 if state == INSIDE else b.records0
        ending = b.end1 if state == INSIDE else b.end0
        out.append((b.file, b.block, state, ending, before, n))
        state, before = ending, before + n
    return pd.DataFrame(out, columns=["file", "block", "state", "ending", "before", "records"])


def block_states(lines: DataFrame, paths: DataFrame) -> DataFrame:
    """id, file, block, state and ending (at its beginning and end), before (records of the file that begin earlier), base (rows of earlier files): a row per block."""
    states = cut_lineage(lines.mapInArrow(_summaries, _ddl(_SUMMARY)).groupBy("file").applyInPandas(_composed, _STATES))
    if states.count() > MAX_BLOCKS:
        raise ValueError(f"more than {MAX_BLOCKS} blocks: raise spark.sql.files.maxPartitionBytes")
    files = states.groupBy("file").agg(F.greatest(F.sum("records") - 1, F.lit(0)).alias("n")).join(paths, "file", "left")  # without the header
    lost = F.raise_error(F.lit("a file that was read is not among the files")).cast("string")
    earlier = Window.orderBy(F.coalesce("path", lost)).rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    states = states.join(files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "file")
    return states.withColumn("id", F.xxhash64("file", "block"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that begin and end in one block, and the pieces of the others (at most one of a record in a block)."""
    key, state, number, begun = None, OUTSIDE, 0, False
    open_lines: list[str] = []   # of a record that a batch did not end

    for batch in batches:
        ids = batch["id"].to_numpy()
        for begin, end in _runs(ids):
            more: list[tuple] = []
            fresh = int(ids[begin]) != key
            if fresh:
                if open_lines:
                    more.append((key, number, False, "\n".join(open_lines)))  # goes on in the next block
                    open_lines = []
                key, state, number, begun = int(ids[begin]), batch["state"][begin].as_py(), batch["before"][begin].as_py() - 1, False
            part = batch["line"].slice(begin, end - begin)
            lines = _Lines(_without_mark(part) if fresh and batch["block"][begin].as_py() == 0 else part)
            inside = lines.inside(state)
            begins, ends = lines.filled & ~inside[:-1], ~inside[1:]
            numbers = number + np.cumsum(begins)
            single = np.flatnonzero(begins & ends)
            # the lines of longer records; each record ends with the first line that ends outside
            long = np.flatnonzero(inside[:-1] | (begins & ~ends))
            texts, at = lines.lines.take(pa.array(long)).to_pylist(), 0
            for last in np.flatnonzero(ends[long]).tolist():
                record = open_lines + texts[at:last + 1]
                whole = begun if open_lines or inside[long[at]] else True
                more.append((key, int(numbers[long[last]]), bool(whole), "\n".join(record)))
                open_lines, at = [], last + 1
            if at < len(long):
                begun = begun if open_lines or inside[long[at]] else True
                open_lines = open_lines + texts[at:]
            elif begins.any():
                begun = True
            number, state = int(numbers[-1]), int(inside[-1])
            yield _batch([np.full(len(single), key), numbers[single], np.ones(len(single), bool), lines.lines.take(pa.array(single))], _PIECES)
            if more:
                yield _batch([list(c) for c in zip(*more, strict=True)], _PIECES)
    if open_lines:
        yield _batch([[key], [number], [False], ["\n".join(open_lines)]], _PIECES)


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """row_id, text -- every record of the files but their headers, in file order."""
    workers_find_package(spark)
    lines = _lines(spark, path)
    states = cut_lineage(block_states(lines, _paths(spark, path)))
    moved = F.raise_error(F.lit("the blocks of the files moved between two reads")).cast("int")
    known = F.broadcast(states.select("id", "state", "before"))
    placed = lines.withColumn("id", F.xxhash64("file", "block")).join(known, "id", "left").withColumn("state", F.coalesce("state", moved))
    cut = placed.select("id", "block", "state", "before", "line").mapInArrow(_cut, _ddl(_PIECES))
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/wordloom-io/records-{uuid.uuid4().hex}"
    cut.where("number > 0").write.option("compression", "zstd").parquet(folder)
    cut = spark.read.schema(_ddl(_PIECES)).parquet(folder).join(F.broadcast(states.select("id", "file", "block", "base")), "id")
    pieces = cut.where("not whole").groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("p"), F.first("base").alias("base"))
    joined = pieces.select("base", "number", F.array_join(F.col("p.text"), "\n").alias("text"))
    rows = cut.where("whole").select("base", "number", "text").unionByName(joined)
    return rows.select((F.col("base") + F.col("number") - 1).alias("row_id"), F.regexp_replace("text", "\r$", "").alias("text"))


def scan(spark: SparkSession, path: str | list[str], options: dict[str, str], row_id: str = "row_id") -> DataFrame:
    """The files' columns as strings (names from the first header), and ``row_id``."""
    names = spark.read.options(**options).csv(path).columns  # reads one record
    if row_id in names:
        raise ValueError(f"the files have a column {row_id}: name another for the ids")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    # as a generator: extracting fields from a projected from_csv would parse the record again for every column
    record = F.from_csv("text", schema.toDDL(), options)
    return records(spark, path).select(F.col("row_id").alias(row_id), F.inline(F.array(record)))
