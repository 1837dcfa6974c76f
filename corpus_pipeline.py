"""Corpus preparation in five stages, from documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm import chunk_dedup, language_id, ngram_join, packing, quality
from seriesloom.llm.cutting import text_key
from seriesloom.llm.tables import documents
from seriesloom.staging import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, judged against the languages of all documents."""
    return quality.judge(docs.select(*COLUMNS), quality.references(docs)).filter("kept").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents like one of the labelled languages, learnt from all labelled rows; documents without letters go.

    Without a labelled row nothing can be said of languages: all documents with letters stay.
    """
    model = language_id.fit(docs)
    if not model.langs:
        return docs.select(*COLUMNS).filter(F.col("text").rlike(r"\p{L}"))
    rows = language_id.predict(docs.select(*COLUMNS), model, likeness=True)
    return rows.filter(F.col("likeness") >= language_id.LEAST_LIKENESS).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, null after all others.

    Rows with one doc_id and different texts are judged by their texts. Documents
    without words stay; rows that repeat both doc_id and text become one.
    """
    classes = ngram_join.jaccard_classes(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("text_key").alias("text"))
    best = classes.filter("group_id is not null").groupBy("group_id").agg(F.min(order).alias("best")).select("best.*").unionByName(
        classes.filter("group_id is null").select(order.alias("best")).select("best.*"))
    named = docs.select(*COLUMNS, F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), text_key().alias("key"))
    # the keys of the join are those of the de-duplication, so texts move once
    kept = named.join(best.withColumnRenamed("text", "key"), ["none", "id", "key"], "left_semi")
    return kept.dropDuplicates(["none", "id", "key"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks; texts that lose everything go."""
    rows = chunk_dedup.substring_dedup(docs.select(*COLUMNS)).withColumn("text", F.decode("kept", "UTF-8"))
    return rows.filter("length(text) > 0").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of at most 2048 tokens."""
    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality_rules), ("language ID", language), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("packing", pack)]

#: SQL can express none of the stages' models and tokenizers; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again."""
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
