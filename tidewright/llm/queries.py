"""The thin queries: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import align, ann, bpe, html, lexical, linededup, minhash, mixing, pii, quality, secrets, tokencount, warc
from tidewright.sources.code import ship


#: The setting that holds the key of surrogates.
KEY_SETTING = "spark.tidewright.surrogateKey"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def surrogate_key(spark: SparkSession) -> str:
    """The key of surrogates: KEY_SETTING of the session; without it that of the synthetic tables, which is no secret."""
    return spark.conf.get(KEY_SETTING, None) or "synthetic tables"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(spark, _read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.classes(spark, _read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(spark, _read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymised(spark, _read(spark, sf_dir, "documents"), surrogate_key(spark))
    of = lambda k: F.size(F.filter("found", lambda x: pii.kind_of(x) == k)).cast("long").alias(f"n_{k}")
    kinds = [of(k) for k in ("email", "phone", "ip", "card", "ssn", "iban", "name")]
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("safe").alias("text"), F.size("found").cast("long").alias("n_entities"), *kinds)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(spark, _read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark, _read(spark, sf_dir, "embeddings"))


def op8_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("edits", tokencount.sample_edits(F.col("doc_id"), F.col("text")))
    return tokencount.counted(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.align(spark, _read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.Index(spark, _read(spark, sf_dir, "documents"))
    return lexical.search(spark, index, _read(spark, sf_dir, "benchmark"))


def op13_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup(spark, _read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")
