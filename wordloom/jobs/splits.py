"""End-to-end job over three labelled CSV splits (the reference script's flow).

    python -m wordloom.jobs.splits --train T.csv --val V.csv --test X.csv --out OUT
    spark-submit --py-files wordloom.zip wordloom/jobs/splits.py --train ... --out ...   (cluster)

Steps, each a Spark job: scan the splits with pandas' NA rules (S1) -> resolve
text / label columns (S3) -> label distribution and first-appearance mapping
(A5, A6) -> vocabulary report on train (A3, A4, W2) -> normalise every split
(F13) with per-split statistics (A1, A2), samples and fuzzy examples (W3, W4)
-> fit and select the classifier on train / val (M2, M3) -> evaluate on test
(M4, A7-A9) -> write the splits' heads (S2), processed splits (S6), the
preprocessing artifact (S7), the final report (S8) and the model (S9).
``jobs.score`` scores new comments with the last two.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.operators import labels as lb
from wordloom.operators import metrics as mx
from wordloom.operators import model as md
from wordloom.operators import report as rp
from wordloom.operators import stats as st
from wordloom.operators import vocab as vc
from wordloom.operators.normalize import Normalizer, tokenize
from wordloom.session import cut_lineage, ensure_checkpoint_dir
from wordloom.sources import csv_splits as cs
from wordloom.sources.dictionary import load_dictionary


# Columns the job adds; a file that has one of these names is refused.
ROW, SPLIT, LABEL = "_row", "_split", "_label"


def read_splits(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, str, str]:
    """All splits with the rows' places in file order, plus the resolved text / label columns.

    Roles are resolved by name on the header; only if that fails are column
    types inferred (one extra pass) for the first-string / first-number fallback.
    """
    df = cs.scan_splits(spark, paths, row_id=ROW, split_col=SPLIT)
    header = T.StructType([f for f in df.schema if f.name not in (ROW, SPLIT)])
    if len(header) + 2 != len(df.columns) or LABEL in header.fieldNames():
        raise ValueError(f"the columns {ROW}, {SPLIT} and {LABEL} are reserved")
    roles = cs.resolve_columns(header) if _by_name(header) else _typed_roles(spark, paths["train"])
    return df, roles[0], roles[1]


def _by_name(schema) -> bool:
    names = schema.fieldNames()
    return any(c in names for c in cs.TEXT_CANDIDATES) and any(c in names for c in cs.LABEL_CANDIDATES)


def _typed_roles(spark: SparkSession, path: str) -> tuple[str, str]:
    typed = spark.read.options(header="true", multiLine="true", escape='"', inferSchema="true").csv(path)
    return cs.resolve_columns(typed.schema)


def run(spark: SparkSession, paths: dict[str, str], out: str, min_frequency: int = 3,
        params: md.TrainParams = md.TrainParams()) -> dict[str, str]:
    ensure_checkpoint_dir(spark)
    df, text_col, label_col = read_splits(spark, paths)
    columns = [c for c in df.columns if c not in (ROW, SPLIT)]
    df = cut_lineage(df.withColumn(LABEL, F.col(label_col).cast("string")))
    train = df.filter(F.col(SPLIT) == "train")

    norm = Normalizer(load_dictionary(spark))
    mapping = lb.label_mapping(train, LABEL, ROW)
    oov = vc.frequent_oov(vc.word_frequency(train, text_col, ROW), norm.dictionary, min_frequency)

    toks = tokenize(df, text_col, keys=(ROW, SPLIT))
    forms = norm.materialize(norm.word_forms(toks))  # shared by the statistics, the examples and the texts
    annotated = norm.annotate(toks, forms).withColumnsRenamed({ROW: "row_id", SPLIT: "split"})
    stats = cut_lineage(st.normalization_stats(annotated))
    processed = cut_lineage(norm.normalize(df, text_col, row_id=ROW, forms=forms))
    enc = cut_lineage(lb.encode_labels(processed.select(ROW, SPLIT, F.col(text_col).alias("text"), F.col(LABEL).alias("label")), mapping))

    sel = md.train_select(spark, enc.filter(F.col(SPLIT) == "train"), enc.filter(F.col(SPLIT) == "val"), params)
    labels = [r["label"] for r in mapping.orderBy("idx").collect()]  # the classes
    model = md.with_label_names(sel.model, labels)
    scored = cut_lineage(md.predict(model, enc.filter(F.col(SPLIT) == "test")))
    metrics = cut_lineage(mx.accuracy(scored, "label_idx", "pred_idx"))
    cache = st.fuzzy_cache_size(toks, norm.dictionary)
    test_stats = stats.filter(F.col("split") == "test")
    sizes = processed.groupBy().pivot(SPLIT, ["train", "val", "test"]).agg(F.count(F.lit(1)).cast("long"))

    written = {name: f"{out}/{name}" for name in (
        "split_profile", "label_distribution", "label_mapping", "frequent_oov", "oov_first_seen_20", "sample_rows",
        "normalization_stats", "normalization_rates", "impact_summary", "fuzzy_examples", "model_selection",
        "classification_report", "confusion_matrix", "processed", "artifacts", "report", "model")}
    tables = {
        "label_distribution": lb.label_distribution(train, LABEL),
        "label_mapping": mapping,
        "frequent_oov": oov.select("word", "freq"),
        "oov_first_seen_20": vc.first_seen_top(oov, 20),
        "sample_rows": rp.sample_rows(processed.filter(F.col(SPLIT) == "train"), text_col, LABEL, ROW),
        "normalization_stats": stats,
        "normalization_rates": st.normalization_rates(stats),
        "impact_summary": rp.impact_summary(test_stats),
        "fuzzy_examples": rp.fuzzy_examples(annotated),
        "model_selection": sel.history,
        "classification_report": mx.classification_report(scored, mapping),
        "confusion_matrix": mx.confusion_matrix(scored, mapping, len(labels)),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(written[name])
    # one-row records and the head of each split as JSON
    records = {
        "split_profile": cs.split_profile(df.select(ROW, SPLIT, *columns), SPLIT, ROW).withColumnRenamed(SPLIT, "split"),
        "artifacts": rp.artifact_record(spark, norm.dictionary, mapping, test_stats, cache, norm.params, md.MODEL_TYPE),
        "report": rp.final_report(spark, metrics, test_stats, sizes, norm.params, cache, md.MODEL_TYPE, 512),
    }
    for name, record in records.items():
        record.coalesce(1).write.mode("overwrite").json(written[name])
    cs.write_processed(processed.select(*columns, f"{text_col}_original", F.col(SPLIT).alias("split")), written["processed"]) \
        if "split" not in columns else _write_each(processed, [*columns, f"{text_col}_original"], written["processed"])
    model.write().overwrite().save(written["model"])
    return written


def _write_each(processed: DataFrame, columns: list[str], folder: str) -> None:
    """Processed files that have a column ``split`` of their own: a folder for each split."""
    for split in ("train", "val", "test"):
        cs.write_csv(processed.filter(F.col(SPLIT) == split).select(columns), f"{folder}/{split}")


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    ap.add_argument("--train", required=True)
    ap.add_argument("--val", required=True)
    ap.add_argument("--test", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--min-frequency", type=int, default=3)
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("wordloom-splits").getOrCreate()
    run(spark, {"train": a.train, "val": a.val, "test": a.test}, a.out, a.min_frequency)


if __name__ == "__main__":
    main()
