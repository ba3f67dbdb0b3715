"""Helpers shared by the operators of this subpackage.

Texts reach numpy as the raw UTF-8 buffer of an Arrow column: words, their
hashes and their n-grams are arrays over a slice of rows, so no task holds a
Python object per word.  Slices are cut by bytes (one very long text is a slice
of its own), which bounds a worker's memory by the longest text.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.session import ensure_checkpoint_dir

SLICE_BYTES = 1 << 20
BATCH_ROWS = 500
BATCH_BYTES = 4 << 20
#: Settings of Python workers, unless the session has its own: freed blocks of 4 MB or more go back to the system at
#: once (the C library's default keeps up to twice the largest block ever freed), Arrow's buffers with them.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
# Row bound under which a table of keys (16 bytes or less each) may be broadcast.
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

U64 = np.uint64
_BYTES = np.arange(256)
#: Bytes of words [^\x20\x09-\x0D]+.
SPACED = (_BYTES != 0x20) & ((_BYTES < 0x09) | (_BYTES > 0x0D))
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
ALNUM = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
TO_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, if they get it by no other way (--py-files), in small batches and little memory."""
    small_batches(spark)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` bytes, unless the session asks for smaller ones: texts are long."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))


def small_or_plain(df: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast hint for a table whose counted rows are within the bound, else the table itself."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def free_name(name: str, df: DataFrame) -> str:
    """``name``, with underscores after it if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply): every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, extended on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            steps = np.repeat(np.array([[self.base], [self.inverse]], U64), size, axis=1)
            steps[:, 0] = 1
            self.up, self.down = np.cumprod(steps, axis=1, dtype=U64)
        return self.up[:n], self.down[:n]

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A polynomial hash of values[start:end] for each span, the same wherever the span lies."""
        up, down = self.to(len(values) + 1)
        total = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        return (total[ends] - total[starts]) * down[starts]


_BYTE_POWERS = Powers(0x9E3779B97F4A7C15)
_WORD_POWERS = (Powers(0xD1342543DE82EF95), Powers(0xAF251AF3B0F025B5))
_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


class Words(NamedTuple):
    """Words of some rows: byte spans in ``data``, 64-bit hashes, and ``first[r]:first[r+1]`` of each row."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def ngrams(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(start word, hash) of each run of k words inside one row."""
        n = len(self.hashes)
        if n < k:
            return np.empty(0, np.int64), np.empty(0, U64)
        last = np.repeat(self.first[1:], np.diff(self.first))
        at = np.flatnonzero(last[: n - k + 1] - np.arange(n - k + 1) >= k)
        return at, mix(_WORD_POWERS[seed].spans(self.hashes, at, at + k))


def words_of(texts: pa.Array, of: np.ndarray, lower: bool) -> Words:
    """Words (runs of bytes in the class ``of``) of an Arrow string array without nulls."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0]: offsets[-1]] if buffer is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = TO_LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = of[data]
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = inside[cut + 1]
    stops[cut - 1] = inside[cut]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    hashes = mix(_BYTE_POWERS.spans(_BYTE_VALUES[data], starts, ends) + (ends - starts).astype(U64))
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Rows in runs of about ``limit`` text bytes, with their texts (null: empty)."""
    for batch in batches:
        texts = pc.fill_null(batch[text].cast(pa.large_string()), "")
        total = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), texts.slice(at, to - at)
            at = to


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch, pa.Array], dict | None], schema: str, text: str = "text") -> DataFrame:
    """``fn(rows, texts) -> columns`` over slices of ``df``; None for nothing."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    workers_find_package(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, text):
            columns = fn(rows, texts)
            if columns is not None:
                yield pa.RecordBatch.from_arrays([column(columns[f.name], f.type) for f in out], names=out.names)
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return df.mapInArrow(run, schema)


def filter_texts(df: DataFrame, keep: Callable[[pa.RecordBatch, pa.Array], np.ndarray], text: str = "text") -> DataFrame:
    """Rows of ``df`` for which ``keep(rows, texts)`` is true, with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, text):
            yield rows.filter(pa.array(keep(rows, texts), pa.bool_()))

    workers_find_package(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    if isinstance(values, np.ndarray) and values.dtype == U64:
        values = values.view(np.int64)
    return pa.array(values, kind)


def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """An Arrow list<int64> column from concatenated values and their row boundaries."""
    values = values.view(np.int64) if values.dtype == U64 else values
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))


def binaries(values: np.ndarray, n: int, width: int) -> pa.Array:
    """An Arrow binary column of ``n`` values of ``width`` bytes each."""
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
