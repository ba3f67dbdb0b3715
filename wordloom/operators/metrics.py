"""Evaluation: accuracy (A7), per-class report (A8), confusion matrix.

All are aggregates over (true, predicted) pairs that sit in the same row
(J7: no join needed).  Class-level tables have one row per class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.session import cut_lineage


def accuracy(df: DataFrame, true_col: str, pred_col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of rows whose prediction equals the truth (rows without truth excluded)."""
    hit = F.coalesce(F.col(true_col) == F.col(pred_col), F.lit(False)).cast("double")  # no prediction is a miss
    rows = df.filter(F.col(true_col).isNotNull())
    aggs = [F.count(F.lit(1)).cast("long").alias("n"), F.avg(hit).alias("accuracy")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def _safe_div(a, b):
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, mapping: DataFrame, true_col: str = "label_idx",
                          pred_col: str = "pred_idx") -> DataFrame:
    """Precision / recall / f1 / support per class, then accuracy, macro avg,
    weighted avg rows (0 on empty denominators, as scikit-learn reports)."""
    rows = df.filter(F.col(true_col).isNotNull())
    truth = rows.groupBy(F.col(true_col).alias("idx")).agg(
        F.count(F.lit(1)).alias("support"),
        F.count_if(F.col(true_col) == F.col(pred_col)).alias("tp"),
    )
    predicted = rows.groupBy(F.col(pred_col).alias("idx")).agg(F.count(F.lit(1)).alias("predicted"))
    per = (
        F.broadcast(mapping).join(truth, "idx", "left").join(predicted, "idx", "left")
        .fillna(0, ["support", "tp", "predicted"])
        .withColumn("precision", _safe_div(F.col("tp"), F.col("predicted")))
        .withColumn("recall", _safe_div(F.col("tp"), F.col("support")))
        .withColumn(
            "f1_score",
            F.when(F.col("precision") + F.col("recall") > 0,
                   F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
            .otherwise(F.lit(0.0)),
        )
    )
    per = cut_lineage(per)  # one row per class, read by the class rows and the summary rows
    classes = per.select(
        F.col("label").alias("class"), "precision", "recall", "f1_score",
        F.col("support").cast("long").alias("support"),
    )
    tot = per.agg(
        F.sum("support").alias("s"), F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("k"),
        F.sum("precision").alias("sp"), F.sum("recall").alias("sr"), F.sum("f1_score").alias("sf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1_score") * F.col("support")).alias("wf"),
    )
    acc = tot.select(
        F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), _safe_div(F.col("tp"), F.col("s")).alias("f1_score"),
        F.col("s").cast("long").alias("support"),
    )
    macro = tot.select(
        F.lit("macro avg").alias("class"), (F.col("sp") / F.col("k")).alias("precision"),
        (F.col("sr") / F.col("k")).alias("recall"), (F.col("sf") / F.col("k")).alias("f1_score"),
        F.col("s").cast("long").alias("support"),
    )
    weighted = tot.select(
        F.lit("weighted avg").alias("class"), _safe_div(F.col("wp"), F.col("s")).alias("precision"),
        _safe_div(F.col("wr"), F.col("s")).alias("recall"), _safe_div(F.col("wf"), F.col("s")).alias("f1_score"),
        F.col("s").cast("long").alias("support"),
    )
    return classes.unionByName(acc).unionByName(macro).unionByName(weighted)


# Classes that a matrix may have as columns; beyond, see ``confusion_pairs``.
MAX_CLASSES = 1_000


def confusion_pairs(df: DataFrame, true_col: str = "label_idx", pred_col: str = "pred_idx") -> DataFrame:
    """A9 in long form, for any number of classes: true_idx, pred_idx, n of the pairs that occur."""
    rows = df.filter(F.col(true_col).isNotNull())
    return rows.groupBy(F.col(true_col).alias("true_idx"), F.col(pred_col).alias("pred_idx")).agg(F.count(F.lit(1)).cast("long").alias("n"))


def confusion_matrix(df: DataFrame, mapping: DataFrame, class_count: int,
                     true_col: str = "label_idx", pred_col: str = "pred_idx") -> DataFrame:
    """rows = true class, columns ``pred_<i>`` = predicted class, zero-filled; at most ``MAX_CLASSES`` classes."""
    if class_count > MAX_CLASSES:
        raise ValueError(f"{class_count} classes are too many for a matrix of columns: use confusion_pairs")
    rows = df.filter(F.col(true_col).isNotNull())
    idx = list(range(class_count))
    counts = (
        rows.groupBy(F.col(true_col).alias("idx")).pivot(pred_col, idx).agg(F.count(F.lit(1)))
    )
    full = F.broadcast(mapping).join(counts, "idx", "left")
    return full.select(
        F.col("label").alias("true_label"), F.col("idx").alias("true_idx"),
        *[F.coalesce(F.col(str(i)), F.lit(0)).cast("long").alias(f"pred_{i}") for i in idx],
    )
