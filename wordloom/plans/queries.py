"""Named queries over the driver tables: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads whole tables (SURVEY §7.1 mapping in ``inputs``) and names
every computed column exactly as its DuckDB oracle in ``plans.oracle`` does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions import text as tx
from wordloom.jobs.score import Scorer
from wordloom.operators import features as fe
from wordloom.operators import labels as lb
from wordloom.operators import metrics as mx
from wordloom.operators import model as md
from wordloom.operators import report as rp
from wordloom.operators import stats as st
from wordloom.operators import vocab as vc
from wordloom.operators.layout import spread_by
from wordloom.operators.match import MatchParams, fuzzy_candidates, oov_words
from wordloom.operators.normalize import Normalizer, lookup_words, text_words, tokenize
from wordloom.plans import inputs
from wordloom.session import cut_lineage
from wordloom.sources import csv_splits as cs
from wordloom.sources.dictionary import default_entries, load_dictionary, merge_entries
from wordloom.sources.video import comments_for_videos
from wordloom.streaming import stream as sm

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Parameters used by the reference script.
MIN_FREQUENCY_SCRIPT = 3   # build_vocabulary_from_data(..., min_frequency=3)
TOP_N = 20
SAMPLE_ROWS = 5
FUZZY_EXAMPLES = 10


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _normalizer(spark: SparkSession) -> Normalizer:
    return Normalizer(load_dictionary(spark))


def _comment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_by(inputs.comments(spark, sf_dir).select("row_id", "text"), "row_id")


def _comment_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(spread_by(inputs.comments(spark, sf_dir), "row_id"), "text", keys=("row_id", "split"))


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _normalizer(spark)
    return n.annotate(_comment_tokens(spark, sf_dir), n.text_forms(_comment_texts(spark, sf_dir)))


def _comment_answers(spark: SparkSession, sf_dir: str, n: Normalizer) -> tuple[DataFrame, tuple[DataFrame, bool]]:
    """The comments' distinct raw words and their answers, made once for the passes that share them."""
    raw = cut_lineage(text_words(_comment_texts(spark, sf_dir)))
    return raw, n.materialize(n.answers(raw))


def _word_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _normalizer(spark)
    return n.raw_word_map(text_words(_comment_texts(spark, sf_dir)))


# -- sources ----------------------------------------------------------------
@query
def dictionary_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 + J5: default table, domain table on top (last value, first position),
    with the number of comment tokens each key answered (any stage)."""
    merged = merge_entries(default_entries(spark, custom=True)).select("ord", "key", "value")
    hits = (
        _annotated(spark, sf_dir).filter(F.col("stage").isin("exact", "fuzzy", "stretch"))
        .groupBy(F.col("match_key").alias("key")).agg(F.count(F.lit(1)).cast("long").alias("n_tokens"))
    )
    return merged.join(hits, "key", "left").select(
        "ord", "key", "value", F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens")
    )


# -- scalar functions -----------------------------------------------------------
@query
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whitespace tokens with their position."""
    return _comment_tokens(spark, sf_dir).select("row_id", "pos", "word")


@query
def clean_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the cleaned core of every token."""
    t = _comment_tokens(spark, sf_dir)
    return t.select("row_id", "pos", "word", tx.clean_word(F.col("word")).alias("clean"))


@query
def case_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case class of every distinct token."""
    t = _comment_tokens(spark, sf_dir).select("word").distinct()
    return t.select("word", tx.case_pattern(F.col("word")).alias("pattern"))


@query
def destretched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: distinct cleaned words holding a run of 3+ equal characters, collapsed to 2."""
    v = lookup_words(text_words(_comment_texts(spark, sf_dir)))
    return v.filter(F.col("clean").rlike(tx.STRETCH_RUN)).select(
        "clean", tx.destretch(F.col("clean")).alias("collapsed")
    )


@query
def word_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 + F3: every (out-of-dictionary word, key) pair passing the fuzzy gate."""
    n = _normalizer(spark)
    rest = oov_words(lookup_words(text_words(_comment_texts(spark, sf_dir))), n.dictionary)
    c = fuzzy_candidates(rest, n.dictionary, MatchParams())
    return c.select("clean", F.col("key").alias("match_key"), "distance", "similarity")


# -- joins ---------------------------------------------------------------------
def _stage_rows(spark: SparkSession, sf_dir: str, stage: str) -> DataFrame:
    wm = _word_map(spark, sf_dir)
    return wm.filter(F.col("stage") == stage)


@query
def exact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words found as keys, with their token count."""
    ann = _annotated(spark, sf_dir).filter(F.col("stage") == "exact")
    return ann.groupBy("clean", "match_key", "value").agg(F.count(F.lit(1)).cast("long").alias("n_tokens"))


@query
def fuzzy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 + W1: best key per out-of-dictionary word."""
    return _stage_rows(spark, sf_dir, "fuzzy").select("clean", "match_key", "value", "similarity")


@query
def stretch_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words whose collapsed form is a key (after exact and fuzzy failed)."""
    return _stage_rows(spark, sf_dir, "stretch").select("clean", "match_key", "value")


@query
def oov_words_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct cleaned words that are not keys."""
    n = _normalizer(spark)
    return oov_words(lookup_words(text_words(_comment_texts(spark, sf_dir))), n.dictionary).select("clean")


@query
def word_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade's answer per distinct word (hits only)."""
    return _word_map(spark, sf_dir).select("clean", "stage", "match_key", "value", "similarity")


# -- normalisation ------------------------------------------------------------
@query
def normalized_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every token with its stage and normalised form."""
    return _annotated(spark, sf_dir).select("row_id", "pos", "word", "stage", "out_word")


@query
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normalised text of every comment ('' for null / blank)."""
    c = inputs.comments(spark, sf_dir).select("row_id", "text")
    done = _normalizer(spark).normalize(c, "text", keep_original=False)
    # without blank dictionary values the filter drops just the texts that are blank from the start
    return done.unionByName(c.filter(tx.is_blank(F.col("text"))).select("row_id", F.lit("").alias("text")))


@query
def preprocess_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13 (flagship): all columns, text normalised, text_original last, blanks removed."""
    return _normalizer(spark).normalize(inputs.comments(spark, sf_dir), "text")


@query
def blank_rows_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per split before and after the blank filter."""
    counts = _normalizer(spark).blank_counts(inputs.comments(spark, sf_dir), "split")
    return counts.withColumn("removed", F.col("rows_in") - F.col("rows_out"))


@query
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: rows whose text changed (whitespace clean-up alone counts)."""
    done = _normalizer(spark).normalize(inputs.comments(spark, sf_dir), "text")
    changed = ~F.col("text_original").eqNullSafe(F.col("text"))
    return done.groupBy("split").agg(
        F.count_if(changed).cast("long").alias("changed"),
        F.count_if(~changed).cast("long").alias("unchanged"),
    )


# -- statistics -------------------------------------------------------------------
@query
def normalization_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 per split."""
    return st.normalization_stats(_annotated(spark, sf_dir))


@query
def normalization_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 per split."""
    return st.normalization_rates(st.normalization_stats(_annotated(spark, sf_dir)))


@query
def oov_distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: memo size over all splits."""
    return st.fuzzy_cache_size(None, _normalizer(spark).dictionary, raw=text_words(_comment_texts(spark, sf_dir)))


# -- vocabulary ------------------------------------------------------------------
def _train_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.comments(spark, sf_dir).filter(F.col("split") == "train")


@query
def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 over the train split."""
    return vc.word_frequency(_train_texts(spark, sf_dir)).select("word", "freq")


@query
def frequent_oov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: count >= 3 (as the script calls it) and not a key."""
    d = _normalizer(spark).dictionary
    return vc.frequent_oov(vc.word_frequency(_train_texts(spark, sf_dir)), d, MIN_FREQUENCY_SCRIPT).select("word", "freq")


@query
def oov_first_seen_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's "top 20" (first 20 by appearance, then by count)."""
    d = _normalizer(spark).dictionary
    oov = vc.frequent_oov(vc.word_frequency(_train_texts(spark, sf_dir)), d, MIN_FREQUENCY_SCRIPT)
    return vc.first_seen_top(oov, TOP_N)


@query
def oov_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true top 20 by count, ties by word."""
    d = _normalizer(spark).dictionary
    oov = vc.frequent_oov(vc.word_frequency(_train_texts(spark, sf_dir)), d, MIN_FREQUENCY_SCRIPT)
    return vc.top_k(oov, TOP_N)


# -- labels and metrics ---------------------------------------------------------
def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.labelled_comments(spark, sf_dir)


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.label_mapping(_labelled(spark, sf_dir).filter(F.col("split") == "train"))


@query
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 over the train split."""
    return lb.label_distribution(_labelled(spark, sf_dir).filter(F.col("split") == "train"))


@query
def label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-appearance order of the train labels."""
    return _mapping(spark, sf_dir)


@query
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled row with its label index (null if unseen in train)."""
    enc = lb.encode_labels(_labelled(spark, sf_dir), _mapping(spark, sf_dir))
    return enc.select("row_id", "split", "label", "label_idx")


def _scored_stand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mapping(spark, sf_dir)
    enc = lb.encode_labels(_labelled(spark, sf_dir), m)
    return lb.encode_labels(enc, m, label_col="pred", out_col="pred_idx")


@query
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 per split, for the stand-in prediction."""
    return mx.accuracy(_scored_stand_in(spark, sf_dir), "label_idx", "pred_idx", by=("split",))


@query
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 on the test split, for the stand-in prediction."""
    rows = _scored_stand_in(spark, sf_dir).filter(F.col("split") == "test")
    return mx.classification_report(rows, _mapping(spark, sf_dir))


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 on the test split, for the stand-in prediction."""
    m = _mapping(spark, sf_dir)
    n_classes = m.count()  # number of classes (one row per class)
    rows = _scored_stand_in(spark, sf_dir).filter(F.col("split") == "test")
    return mx.confusion_matrix(rows, m, n_classes)


def registry() -> dict[str, Query]:
    out = dict(REGISTRY)
    out["oov_words"] = out.pop("oov_words_query")
    return out


# -- sources and sinks ------------------------------------------------------------

LABELLED_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()),
])
PROCESSED_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("n_chars", T.LongType()),
])
DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def _csv_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the labelled comments as three CSV splits, scan them back."""
    folder = cs.scratch_folder(spark, "splits")
    paths = cs.write_splits(_labelled(spark, sf_dir).select("row_id", "split", "text", "label"), folder)
    return cs.scan_splits(spark, paths, LABELLED_SCHEMA)


@query
def scan_csv_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + U1: three CSV splits read with pandas' NA rules into one frame."""
    return _csv_splits(spark, sf_dir).select("row_id", "split", "text", "label")


@query
def split_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per split, column names and the first two rows of each scanned split."""
    p = cs.split_profile(_csv_splits(spark, sf_dir))
    rows = [F.get("head", i)[c].alias(f"{c}_{i + 1}") for i in (0, 1) for c in ("row_id", "text", "label")]
    return p.select("split", "n_rows", "n_columns", F.array_join("column_names", ",").alias("column_names"), *rows)


@query
def resolve_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: text / label column roles resolved for every driver table's schema,
    with the table's row count."""
    parts = []
    for name in DRIVER_TABLES:
        t = inputs.table(spark, sf_dir, name)
        try:
            text_col, label_col = cs.resolve_columns(t.schema)
        except ValueError:
            continue
        parts.append(t.agg(
            F.lit(name).alias("table_name"), F.lit(text_col).alias("text_col"), F.lit(label_col).alias("label_col"),
            F.count(F.lit(1)).cast("long").alias("n_rows"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def processed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed splits written as CSV (partitioned by split) and read back."""
    done = _normalizer(spark).normalize(inputs.comments(spark, sf_dir), "text")
    folder = cs.scratch_folder(spark, "processed")
    cs.write_processed(done, folder)
    back = cs.read_processed(spark, folder, PROCESSED_SCHEMA)
    return back.select("row_id", "split", "text", "lang", "source", "text_original")


def _joined(entries):
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")


@query
def artifact_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preprocessing artifact (test-split counters, as the reference
    saves them) written as JSON and read back."""
    n = _normalizer(spark)
    raw, forms = _comment_answers(spark, sf_dir, n)
    stats = st.normalization_stats(n.annotate(_comment_tokens(spark, sf_dir), forms)).filter(F.col("split") == "test")
    rec = rp.artifact_record(
        spark, n.dictionary, _mapping(spark, sf_dir), stats,
        st.fuzzy_cache_size(None, n.dictionary, raw=raw), n.params, md.MODEL_TYPE,
    )
    folder = cs.scratch_folder(spark, "artifacts")
    rec.coalesce(1).write.mode("overwrite").json(folder)
    back = spark.read.schema(rec.schema).json(folder)
    return back.select(
        "model_type", "levenshtein_threshold", "fuzzy_threshold",
        F.col("normalization_stats.exact_matches").alias("exact_matches"),
        F.col("normalization_stats.fuzzy_matches").alias("fuzzy_matches"),
        F.col("normalization_stats.no_matches").alias("no_matches"),
        F.col("normalization_stats.total_words").alias("total_words"),
        "fuzzy_cache_size",
        # the maps' contents, in their own order
        _joined(F.map_entries("normalization_dict")).alias("dictionary_pairs"),
        _joined(F.map_entries("label_mapping")).alias("label_pairs"),
    )


@query
def comments_for_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every requested video's comments, normalised (blank comments dropped)."""
    feed = inputs.video_comments(spark, sf_dir)
    rows = comments_for_videos(inputs.video_requests(spark, sf_dir), feed)
    keyed = rows.select(F.struct("url", "video_id", "turn").alias("row_id"), "role", "text")
    done = _normalizer(spark).normalize(keyed, "text")
    return done.select(
        F.col("row_id.url").alias("url"), F.col("row_id.video_id").alias("video_id"), F.col("row_id.turn").alias("turn"),
        "role", "text", "text_original",
    )


@query
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First five processed train rows with label and changed flag."""
    n = _normalizer(spark)
    lab = _labelled(spark, sf_dir).filter(F.col("split") == "train").select("row_id", "text", "label")
    return rp.sample_rows(n.normalize(rp.first_texts(lab, n.dictionary, n=SAMPLE_ROWS), "text"), n=SAMPLE_ROWS)


@query
def fuzzy_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First ten fuzzy corrections by first appearance, and how many there are."""
    return rp.fuzzy_examples(_annotated(spark, sf_dir), FUZZY_EXAMPLES)


# -- encoding and model ----------------------------------------------------------

ENCODER = fe.EncoderParams()
TRAIN = md.TrainParams()
_TRAINED: dict[tuple[str, str], tuple] = {}


def _processed_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13 over all comments, checkpointed (used by several branches)."""
    return cut_lineage(_normalizer(spark).normalize(inputs.comments(spark, sf_dir), "text"))


@query
def encoded_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: ids + mask, truncated / padded to 512, vocabulary learned on train."""
    done = _processed_comments(spark, sf_dir)
    vocab = fe.learn_vocabulary(done.filter(F.col("split") == "train"))
    enc = fe.encode(done, vocab, ENCODER, carry=("split",))
    return enc.select(
        "row_id", "split",
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"),
        F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
    )


@query
def encoder_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: the encoder's vocabulary (every train token, by frequency, ids after the specials)."""
    done = _processed_comments(spark, sf_dir)
    return fe.learn_vocabulary(done.filter(F.col("split") == "train"))


def _trained(spark: SparkSession, sf_dir: str, forms: tuple[DataFrame, bool] | None = None):
    """Processed labelled rows with label indices, the label list and the selected model.

    ``forms``: the comments' answers, if another pass has made them (the labelled words are among them)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _TRAINED:
        return _TRAINED[key]
    mapping = _mapping(spark, sf_dir)
    lab = _labelled(spark, sf_dir).select("row_id", "split", "text", "label")
    done = _normalizer(spark).normalize(lab, "text", forms=forms)
    enc = cut_lineage(lb.encode_labels(done, mapping))
    labels = [r["label"] for r in mapping.orderBy("idx").collect()]  # the classes (one row each)
    sel = md.train_select(spark, enc.filter(F.col("split") == "train"), enc.filter(F.col("split") == "val"), TRAIN)
    _TRAINED[key] = (enc, mapping, labels, sel)
    return _TRAINED[key]


@query
def trained_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 + M5: the selected model's prediction for every labelled comment."""
    enc, _, labels, sel = _trained(spark, sf_dir)
    return md.predict(sel.model, enc, labels).select(
        "row_id", "split", "label", "predicted_class", "confidence"
    )


@query
def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: validation accuracy per round, early stop, best round flagged."""
    return _trained(spark, sf_dir)[3].history


@query
def test_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 + A8: report of the selected model on the test split."""
    enc, mapping, labels, sel = _trained(spark, sf_dir)
    scored = md.predict(sel.model, enc.filter(F.col("split") == "test"), labels)
    return mx.classification_report(scored, mapping, "label_idx", "pred_idx")


def _saved_run(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A folder with what scoring needs: the preprocessing artifact and the selected pipeline, as the splits job writes them; and the comments' distinct raw words."""
    n = _normalizer(spark)
    raw, forms = _comment_answers(spark, sf_dir, n)
    _, mapping, labels, sel = _trained(spark, sf_dir, forms)
    stats = st.normalization_stats(n.annotate(_comment_tokens(spark, sf_dir), forms)).filter(F.col("split") == "test")
    folder = cs.scratch_folder(spark, "run")
    rec = rp.artifact_record(spark, n.dictionary, mapping, stats, st.fuzzy_cache_size(None, n.dictionary, raw=raw), n.params, md.MODEL_TYPE)
    rec.coalesce(1).write.mode("overwrite").json(f"{folder}/artifacts")
    md.with_label_names(sel.model, labels).write().overwrite().save(f"{folder}/model")
    return folder, raw


@query
def scored_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 + F16 + P4: every comment normalised and scored into the five-field record, from the saved run alone."""
    run, raw = _saved_run(spark, sf_dir)
    return Scorer.load(spark, run).score(inputs.comments(spark, sf_dir), raw=raw)


@query
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 + P4: the fitted pipeline saved with its label names, loaded back, and scoring the test split the same way."""
    enc, _, labels, sel = _trained(spark, sf_dir)
    folder = cs.scratch_folder(spark, "model")
    md.with_label_names(sel.model, labels).write().overwrite().save(folder)
    loaded = md.PipelineModel.load(folder)
    test = enc.filter(F.col("split") == "test")
    fields = ("predicted_class", "confidence", "all_probabilities")
    a = md.predict(sel.model, test, labels).select("row_id", "label", F.struct(*fields).alias("before"))
    b = md.predict(loaded, test).select("row_id", F.struct(*fields).alias("after"))
    text = lambda c: F.to_json(c)  # noqa: E731  (maps cannot be compared)
    return a.join(b, "row_id").select("row_id", "label", (text("before") == text("after")).alias("same"))


def _final_parts(spark: SparkSession, sf_dir: str):
    """What the final records are made of, with the stand-in prediction's accuracy (the job reports the model's)."""
    scored = _scored_stand_in(spark, sf_dir).filter(F.col("split") == "test")
    metrics = mx.accuracy(scored, "label_idx", "pred_idx")
    n = _normalizer(spark)
    raw, forms = _comment_answers(spark, sf_dir, n)
    stats = st.normalization_stats(n.annotate(_comment_tokens(spark, sf_dir), forms)).filter(F.col("split") == "test")
    lab = _labelled(spark, sf_dir).select("row_id", "split", "text")
    done = n.normalize(lab, "text", keep_original=False, forms=forms)  # their words are among the comments' words
    sizes = done.groupBy().pivot("split", list(inputs.SPLITS)).agg(F.count(F.lit(1)).cast("long"))
    # one-row tables, read by several scalar subqueries: materialise once
    return n, raw, cut_lineage(metrics), cut_lineage(stats), cut_lineage(sizes)


@query
def final_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: test accuracy, split sizes, words processed / normalised and the rate."""
    _, _, metrics, stats, sizes = _final_parts(spark, sf_dir)
    s = rp.impact_summary(stats)
    return rp.one_row(
        spark,
        test_accuracy=metrics.select("accuracy").scalar(),
        train_samples=sizes.select("train").scalar(),
        val_samples=sizes.select("val").scalar(),
        test_samples=sizes.select("test").scalar(),
        **{c: s.select(c).scalar() for c in s.columns},
    )


@query
def report_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final report record written as JSON and read back, its fields side by side."""
    n, raw, metrics, stats, sizes = _final_parts(spark, sf_dir)
    rec = rp.final_report(spark, metrics, stats, sizes, n.params, st.fuzzy_cache_size(None, n.dictionary, raw=raw),
                          md.MODEL_TYPE, ENCODER.max_length)
    folder = cs.scratch_folder(spark, "report")
    rec.coalesce(1).write.mode("overwrite").json(folder)
    return spark.read.schema(rec.schema).json(folder).select(
        "model_performance.*", "preprocessing_stats.*", "dataset_info.*", "fuzzy_matching.*")


@query
def probability_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: class probabilities as a label -> probability map, confidence = its max."""
    enc, _, labels, sel = _trained(spark, sf_dir)
    return md.predict(sel.model, enc, labels).select(
        "row_id", "predicted_class", "confidence", "all_probabilities"
    )


# -- streaming ---------------------------------------------------------------------


# A micro-batch takes files of about this many bytes: what a batch costs at least is paid per bytes, not per file.
BATCH_BYTES = 256 << 20


def _documents_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a file stream (glob: the folder holds other tables too)."""
    schema = inputs.table(spark, sf_dir, "documents").schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(f"{sf_dir}/documents.parque[t]")


def _run_comment_stream(spark: SparkSession, sf_dir: str) -> tuple[sm.StreamOutput, str]:
    folder = cs.scratch_folder(spark, "stream")
    out = sm.run_stream(spark, _documents_stream(spark, sf_dir), _normalizer(spark), f"{folder}/out",
                        f"{folder}/checkpoint", prepare=inputs.as_comments)
    return out, folder


@query
def stream_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 (text part): the stream's processed rows equal the batch F13 result."""
    out, _ = _run_comment_stream(spark, sf_dir)
    return spark.read.parquet(out.rows_path).select("row_id", "split", "text", "lang", "source", "text_original")


@query
def stream_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving comments normalised and scored from a saved run; ``same``: as the batch scores them."""
    run, raw = _saved_run(spark, sf_dir)
    scorer = Scorer.load(spark, run)
    folder = cs.scratch_folder(spark, "stream-scored")
    arriving = inputs.as_comments(_documents_stream(spark, sf_dir))
    out = scorer.score_stream(spark, arriving, f"{folder}/out", f"{folder}/checkpoint")
    live = md.scored_record(spark.read.parquet(out.rows_path), keys=("row_id",))
    at_rest = scorer.score(inputs.comments(spark, sf_dir), raw=raw)
    result = lambda c: F.to_json(F.struct("predicted_class", "confidence", "all_probabilities")).alias(c)
    both = live.select("row_id", "original_text", "processed_text", result("_live")).join(at_rest.select("row_id", result("_at_rest")), "row_id")
    return both.select("row_id", "original_text", "processed_text", (F.col("_live") == F.col("_at_rest")).alias("same"))


@query
def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running match counters of the stream, kept in the state store."""
    out, folder = _run_comment_stream(spark, sf_dir)
    schema = sm.counts_schema(T.StructField("row_id", T.LongType()), [T.StructField("split", T.StringType())])
    sm.run_totals(spark, out, f"{folder}/totals-checkpoint", schema)
    return sm.running_stats(spark, out, schema)
