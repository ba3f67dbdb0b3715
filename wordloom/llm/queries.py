"""The operators as queries over whole tables: ``opN_<name> -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm import common as cm
from wordloom.llm import alignment, decontam, fingerprints, langid, merkle, minhash, mixing, quality, secretscan, sharding, substring, tokencount, tokenids

TOKENIZER = "word_bpe_49k.json"
SHARDS = {f"shard-{i:02d}": 1 for i in range(16)}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: str = "doc_id"):
    """Documents that no model learns from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cm.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = mixing.taken(docs, mixing.Mix())
    return rows.select("row.doc_id", F.coalesce("row.source", F.lit("")).alias("source"), mixing.tokens_of(F.col("row.text")).alias("n_tokens"), "block", "rank")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(cm.table(spark, sf_dir, "documents"), minhash.NearDup(shingle=3, percent=85))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.remove_repeats(cm.table(spark, sf_dir, "documents"), 13)
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secretscan.scan(cm.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(cm.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cm.table(spark, sf_dir, "documents")
    net = langid.train(docs.where(~held_out()))
    return langid.predict(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(cm.table(spark, sf_dir, "documents"), cm.table(spark, sf_dir, "benchmark"), 10)


def written_and_read(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from a newly written folder, through its index."""
    path = tokenids.fresh_path(spark, "token-ids")
    tokenids.write(docs, path, tokenizer_path())
    found = tokenids.lookup(spark, path, docs.select("doc_id"))
    return tokenids.read(spark, path, found, tokenids.ids_crc32, "bigint").withColumnRenamed("value", "ids_crc32")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_and_read(spark, cm.table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(cm.table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.placed(cm.table(spark, sf_dir, "documents"), SHARDS)
    return rows.select("row.doc_id", "slot", "shard", F.coalesce(F.octet_length("row.text"), F.lit(0)).cast(T.LongType()).alias("n_bytes"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    rows = merkle.manifest(cm.table(spark, sf_dir, "documents"), tampered={"text": F.translate("text", "\n", "")}, when=even)
    return merkle.verified(rows)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(cm.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.with_classes(cm.table(spark, sf_dir, "documents"))
    text = lambda c: F.lower(F.hex(c))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "class_id")


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_mixing, op2_near_duplicates, op3_substring_dedup, op4_secrets, op5_quality, op6_language_id, op7_decontamination,
        op8_token_ids, op9_token_counts, op10_sharding, op11_merkle, op12_token_alignment, op13_fingerprints,
    )}
