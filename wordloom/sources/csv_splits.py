"""Labelled CSV splits: scan (S1), profile (S2), column roles (S3), write.

The reference reads each split with pandas defaults; Spark's CSV reader only
nulls the empty cell, so the scan applies pandas' default NA strings itself
(exact match, no trimming).  Files are read in blocks (``csv_records``).  Splits become one DataFrame with a ``split``
column instead of three separate frames.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wordloom.session import ensure_checkpoint_dir, workers_find_package
from wordloom.sources import csv_records

# Pandas.read_csv's default NA strings.
PANDAS_NA = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Candidate column names, in the reference's order of preference.
TEXT_CANDIDATES = ["text", "comment", "sentence", "content", "message"]
LABEL_CANDIDATES = ["label", "class", "category", "hope_speech"]

# Each split of a scan has its own range of row ids.
SPLIT_IDS = 1 << 52

_CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}
_WRITE_OPTIONS = {**_CSV_OPTIONS, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
                  "quoteAll": "true"}


def na_to_null(c: Column) -> Column:
    """pandas default NA strings -> NULL (string columns)."""
    return F.when(c.isin(PANDAS_NA), F.lit(None).cast("string")).otherwise(c)


def scan_split(spark: SparkSession, path: str, split: str, schema: T.StructType | None = None,
               row_id: str | None = None, split_col: str = "split") -> DataFrame:
    """One split as strings with pandas NA rules, then cast to ``schema`` if given.

    Files are read in blocks, whatever their size (``csv_records``).  ``row_id`` names
    a column for the rows' places in the split (files in the order of their paths).
    """
    place = row_id or "_place"
    raw = csv_records.scan(spark, path, _CSV_OPTIONS, place)
    cols = [F.col(place)] if row_id else []
    for name in (c for c in raw.columns if c != place):
        c = na_to_null(F.col(name))
        if schema is not None and name in schema.fieldNames():
            c = c.cast(schema[name].dataType)
        cols.append(c.alias(name))
    return raw.select(*cols, F.lit(split).alias(split_col))


def scan_splits(spark: SparkSession, paths: dict[str, str], schema: T.StructType | None = None,
                row_id: str | None = None, split_col: str = "split") -> DataFrame:
    """S1 + U1: all splits as one DataFrame with a ``split`` column; ``row_id``: places, splits one after the other."""
    frames = []
    for i, (split, path) in enumerate(paths.items()):
        one = scan_split(spark, path, split, schema, row_id, split_col)
        frames.append(one.withColumn(row_id, F.lit(i).cast("long") * F.lit(SPLIT_IDS) + F.col(row_id)) if row_id else one)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_splits(df: DataFrame, folder: str, split_col: str = "split") -> dict[str, str]:
    """Write each split as its own CSV folder (header, doubled quotes, blanks kept)."""
    df.write.mode("overwrite").options(**_WRITE_OPTIONS).partitionBy(split_col).csv(folder)
    return {s: f"{folder}/{split_col}={s}" for s in ("train", "val", "test")}


def write_processed(df: DataFrame, folder: str, split_col: str = "split") -> None:
    """Processed splits, all columns, partitioned by split."""
    df.write.mode("overwrite").options(**_WRITE_OPTIONS).partitionBy(split_col).csv(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").options(**_WRITE_OPTIONS).csv(folder)


def read_processed(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    raw = spark.read.options(**_CSV_OPTIONS).csv(folder)
    cols = []
    for name in raw.columns:
        c = F.col(name) if name == "split" else na_to_null(F.col(name))
        if schema is not None and name in schema.fieldNames():
            c = c.cast(schema[name].dataType)
        cols.append(c.alias(name))
    return raw.select(*cols)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/wordloom-io/{name}-{uuid.uuid4().hex[:12]}"


def resolve_columns(schema: T.StructType) -> tuple[str, str]:
    """S3: text and label columns by name; if either is missing, both fall back
    to the first string column and the first integral / floating column."""
    names = schema.fieldNames()
    text = next((c for c in TEXT_CANDIDATES if c in names), None)
    label = next((c for c in LABEL_CANDIDATES if c in names), None)
    if text is None or label is None:
        strings = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
        numbers = [f.name for f in schema.fields
                   if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType,
                                              T.DoubleType, T.FloatType))]
        if not strings or not numbers:
            raise ValueError(f"cannot resolve text/label columns from {names}")
        text, label = strings[0], numbers[0]
    return text, label


def split_profile(df: DataFrame, split_col: str = "split", row_id: str = "row_id", n: int = 2) -> DataFrame:
    """Rows per split, the columns' names, and the first ``n`` rows (``head``) with all their columns.

    One scan: every task counts its rows of a split and keeps the ``n`` with the
    smallest ids; these few rows are merged.
    """
    names = [row_id, *(c for c in df.columns if c not in (row_id, split_col))]
    fields = T.StructType([df.schema[c] for c in names])
    schema = T.StructType([df.schema[split_col], T.StructField("n_rows", T.LongType()), T.StructField("head", T.ArrayType(fields))])
    arrow = to_arrow_schema(schema)

    def first(rows: list[dict]) -> list[dict]:
        return sorted(rows, key=lambda r: (r[row_id] is None, r[row_id]))[:n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        heads: dict = {}
        for batch in batches:
            for split in pc.unique(batch[split_col]):
                here = pc.is_null(batch[split_col]) if not split.is_valid else pc.fill_null(pc.equal(batch[split_col], split), False)
                part = batch.filter(here).select(names)
                key = split.as_py()
                counts[key] = counts.get(key, 0) + len(part)
                top = part.take(pc.select_k_unstable(part, k=min(n, len(part)), sort_keys=[(row_id, "ascending")]))
                heads[key] = first(heads.get(key, []) + top.to_pylist())
        rows = [{split_col: k, "n_rows": counts[k], "head": heads[k]} for k in counts]
        yield pa.RecordBatch.from_pylist(rows, arrow)

    workers_find_package(df.sparkSession)
    parts = df.select(split_col, *names).mapInArrow(run, schema)
    return parts.groupBy(split_col).agg(
        F.sum("n_rows").cast("long").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
        F.array(*[F.lit(c) for c in df.columns]).alias("column_names"),
        F.slice(F.array_sort(F.flatten(F.collect_list("head"))), 1, n).alias("head"),  # n rows of a task
    )
