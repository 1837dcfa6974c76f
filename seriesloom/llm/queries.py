"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import bpe, chat_windows, chunk_dedup, conversation_repair, fingerprints, language_id, licenses, ngram_join, packing, quality, suffix_dedup, token_files, whitening
from seriesloom.llm.tables import documents
from seriesloom.staging import stage, stage_root


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.edited_fingerprints(documents(spark, sf_dir))
    return rows.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), fingerprints.as_text(F.col("fp")).alias("fingerprint"),
                       fingerprints.as_text(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next", "contained", "distinct_shingles")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{stage_root(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_files.checksums(spark, path)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(documents(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.repeated_bytes(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    model = language_id.fit(rows.filter("not held_out"))
    return language_id.predict(rows.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_dedup.substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return quality.judge(docs.drop("lang"), quality.references(docs)).drop("text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = conversation_repair.damaged(conversations)
    plans = stage(conversation_repair.audits(conversation_repair.faults(rows)), "repair-audits")
    found = conversation_repair.digests(rows, plans).withColumnRenamed("conv_id", "_id")
    ids = conversations.select("conv_id").distinct()
    mine = plans.withColumnRenamed("conv_id", "_of")
    joined = ids.join(mine, F.col("conv_id").eqNullSafe(F.col("_of")), "left").join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select("conv_id", *(F.when(F.col("audit").isNull(), 0).otherwise(F.col(c)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"), F.coalesce("n_repaired", F.lit(0)).cast("long").alias("n_repaired"))


def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    spoken = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(spoken).alias("text"))
    return chat_windows.read_back(chat_windows.windows(conversations.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


QUERIES = {f.__name__: f for f in (
    op1_fingerprints, op2_byte_bpe, op3_token_files, op4_ngram_join, op5_suffix_dedup,
    op6_language_id, op7_chunk_dedup, op8_packing, op9_licenses, op10_quality, op11_conversation_repair, op12_chat_windows, op13_whitening)}
#: None of these results is within reach of SQL on whole tables; tests hold them against brute force.
ORACLE: dict[str, str] = {}
