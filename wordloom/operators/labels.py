"""Labels: distribution (A5), first-appearance mapping (A6), encode (P3) and
decode (P4: a stage of the fitted pipeline, ``operators.model.with_label_names``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.session import cut_lineage

# Classes up to which their table is broadcast.
MAX_BROADCAST_LABELS = 100_000

def label_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A5: ``value_counts()`` -- nulls excluded, the most frequent label first (ties by label; one row per class)."""
    return (
        df.filter(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("label"))
        .agg(F.count(F.lit(1)).cast("long").alias("n")).orderBy(F.desc("n"), "label")
    )


def named_nulls(df: DataFrame, label_col: str = "label", name: str = "nan") -> DataFrame:
    """Missing labels as a class of their own, as the reference's ``unique()`` has them; apply before A6 and P3."""
    return df.withColumn(label_col, F.coalesce(F.col(label_col).cast("string"), F.lit(name)))


def label_mapping(train: DataFrame, label_col: str = "label", row_id: str = "row_id") -> DataFrame:
    """Distinct labels in first-appearance order -> 0..n-1; rows without a label have none (see ``named_nulls``).

    The window runs over the distinct labels (the classes), never over rows.
    The result (one row per class) is checkpointed: every later encode /
    decode / report reads that tiny table instead of re-running the scan.
    """
    first = (
        train.filter(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("label"))
        .agg(F.min(row_id).alias("first_row"))
    )
    return cut_lineage(first.select(
        "label", (F.row_number().over(Window.orderBy("first_row")) - 1).cast("int").alias("idx")
    ))


def encode_labels(df: DataFrame, mapping: DataFrame, label_col: str = "label",
                  out_col: str = "label_idx") -> DataFrame:
    """Label -> index; a label the mapping lacks gives null."""
    m = mapping.select(F.col("label").alias("_lbl"), F.col("idx").alias(out_col))
    m = F.broadcast(m) if mapping.count() <= MAX_BROADCAST_LABELS else m
    return df.join(m, F.col(label_col) == F.col("_lbl"), "left").drop("_lbl")

