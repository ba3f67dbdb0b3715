"""Spelling dictionaries (S5) and their override-merge.

A dictionary is a DataFrame ``(src int, line int, key string, value string)``:
``src`` numbers the tables in load order and ``line`` is the entry's line in its
table.  Merging keeps, per key, the value of the **last** entry and the
position of the **first** one (Python ``dict.update`` semantics); the merged
position is the long ``ord = src << 32 | line`` so no global window (one task)
is ever needed to rank keys.

The two tables shipped with the package are tiny fixed lookup tables; they are
parsed on the driver and turned into DataFrames.  User tables are read with
Spark from shared storage.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass, field
from importlib import resources
from importlib.resources.abc import Traversable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions import text as tx
from wordloom.session import cut_lineage

# Package resources, so that the tables are also found inside a zip given by --py-files.
DEFAULT_TABLE = resources.files("wordloom") / "data" / "default_normalizations.csv"
CUSTOM_TABLE = resources.files("wordloom") / "data" / "custom_normalizations.csv"

ENTRY_SCHEMA = T.StructType([
    T.StructField("src", T.IntegerType(), False),
    T.StructField("line", T.IntegerType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), False),
])

# Broadcast bound (rows) for dictionary-side join tables; larger ones use shuffle joins.
MAX_BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Dictionary:
    """Merged dictionary plus an upper bound on its number of keys.

    ``df`` columns: ord long, key, value, value_upper, value_title, value_lower.
    ``max_keys`` is the number of input entries (known without a job for the
    packaged tables, counted once for user tables); it gates broadcasting.
    ``key_lengths`` is the (shortest, longest) key length, for lossless
    pruning of words that cannot reach any key.
    """

    df: DataFrame
    max_keys: int
    key_lengths: tuple[int, int] = (0, 1 << 30)
    has_blank_values: bool = False
    variants: dict = field(default_factory=dict, compare=False, repr=False)  # deletion variants made so far, by match parameters

    @property
    def broadcastable(self) -> bool:
        return self.max_keys <= MAX_BROADCAST_ROWS

    def side(self, df: DataFrame | None = None, rows_per_key: int = 1) -> DataFrame:
        """The dictionary (or a frame derived from it with at most ``rows_per_key``
        rows per key) as a join side: broadcast when its bound is under the limit."""
        side = self.df if df is None else df
        return F.broadcast(side) if self.max_keys * rows_per_key <= MAX_BROADCAST_ROWS else side


def read_fixed_table(table: Traversable) -> list[tuple[str, str]]:
    """(key, value) pairs of a packaged table, in file order, comment lines skipped."""
    lines = table.read_text(encoding="utf-8").splitlines()
    return [(r["key"], r["value"]) for r in csv.DictReader(line for line in lines if not line.startswith("#"))]


def fixed_entries(spark: SparkSession, table: Traversable, src: int) -> DataFrame:
    pairs = read_fixed_table(table)
    return spark.createDataFrame(
        [(src, i, k, v) for i, (k, v) in enumerate(pairs)], ENTRY_SCHEMA
    )


def read_entries(spark: SparkSession, path: str, src: int) -> DataFrame:
    """A user table ``key,value[,line]`` (CSV with header) as dictionary entries.

    Without a ``line`` column the order is that of the rows in the file, which only
    a table of one file has; several files need the column.
    """
    raw = (
        spark.read.option("header", True).option("comment", "#")
        .option("multiLine", True).option("escape", '"').csv(path)
    )
    if "line" not in raw.columns and len(raw.inputFiles()) > 1:
        raise ValueError(f"{path}: a dictionary of several files needs a column 'line' for the order of its entries")
    line = F.col("line").cast("int") if "line" in raw.columns else F.monotonically_increasing_id().cast("int")
    return raw.select(F.lit(src).alias("src"), line.alias("line"), "key", "value")


def merge_entries(entries: DataFrame) -> DataFrame:
    """Last value wins, first position kept; one row per key."""
    pos = F.struct("src", "line")
    return (
        entries.groupBy("key")
        .agg(F.min(pos).alias("first"), F.max_by("value", pos).alias("value"))
        .select(
            (F.col("first.src").cast("long") * F.lit(1 << 32) + F.col("first.line")).alias("ord"),
            "key",
            "value",
        )
    )


CASE_FORMS = T.StructType([
    T.StructField("value_upper", T.StringType()),
    T.StructField("value_title", T.StringType()),
    T.StructField("value_lower", T.StringType()),
])


@F.pandas_udf(CASE_FORMS)
def _case_forms(values: pd.Series) -> pd.DataFrame:
    # Python's own str.upper/title/lower: Spark's initcap differs from str.title.
    return pd.DataFrame({
        "value_upper": values.str.upper(),
        "value_title": values.str.title(),
        "value_lower": values.str.lower(),
    })


def with_case_forms(merged: DataFrame) -> DataFrame:
    return merged.withColumn("_cf", _case_forms("value")).select(
        "ord", "key", "value", "_cf.value_upper", "_cf.value_title", "_cf.value_lower"
    )


def default_entries(spark: SparkSession, custom: bool = True) -> DataFrame:
    entries = fixed_entries(spark, DEFAULT_TABLE, 0)
    if custom:
        entries = entries.unionByName(fixed_entries(spark, CUSTOM_TABLE, 1))
    return entries


_LOADED: dict[tuple, Dictionary] = {}


def load_dictionary(spark: SparkSession, custom: bool = True,
                    extra_paths: tuple[str, ...] = ()) -> Dictionary:
    """The default table, the domain table on top (``custom``), then user tables.

    The packaged tables are merged and checkpointed once per application; user
    tables are read anew at each call, as they may have been edited.
    """
    if extra_paths:
        return _load(spark, custom, tuple(extra_paths))
    key = (spark.sparkContext.applicationId, custom)
    if key not in _LOADED:
        _LOADED[key] = _load(spark, custom, ())
    return _LOADED[key]


def _load(spark: SparkSession, custom: bool, extra_paths: tuple[str, ...]) -> Dictionary:
    entries = default_entries(spark, custom)
    bound = len(read_fixed_table(DEFAULT_TABLE)) + (len(read_fixed_table(CUSTOM_TABLE)) if custom else 0)
    for i, path in enumerate(extra_paths):
        extra = read_entries(spark, path, 2 + i)
        bound += extra.count()
        entries = entries.unionByName(extra)
    return dictionary_from_entries(entries, bound)


def dictionary_from_mapping(spark: SparkSession, mapping: dict[str, str] | DataFrame) -> Dictionary:
    """A dictionary given as a mapping in order: a Python dict, or a DataFrame of one row and one map column."""
    if isinstance(mapping, dict):
        rows = [(0, i, k, v) for i, (k, v) in enumerate(mapping.items())]
        return dictionary_from_entries(spark.createDataFrame(rows, ENTRY_SCHEMA), len(rows))
    entries = mapping.select(F.posexplode(mapping.columns[0]).alias("line", "key", "value"))
    entries = cut_lineage(entries.select(F.lit(0).alias("src"), "line", "key", "value"))
    return dictionary_from_entries(entries, entries.count())


def dictionary_from_entries(entries: DataFrame, max_keys: int) -> Dictionary:
    """Merge, add case forms, and checkpoint once: queries then read a plain
    table instead of re-running the merge and the Python case-form UDF."""
    df = cut_lineage(with_case_forms(merge_entries(entries)))
    blank = F.count_if(tx.is_blank(F.col("value")))
    lo, hi, blanks = df.agg(F.min(F.length("key")), F.max(F.length("key")), blank).first()  # three numbers
    return Dictionary(df, max_keys, (int(lo or 0), int(hi or 0)), blanks > 0)
