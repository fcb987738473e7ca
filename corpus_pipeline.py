"""A corpus pipeline of five stages: language ID, near-dedup, secret scans, source mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.llm import minhash_join, mixing, piece_suffixes, secret_links, zstd_language
from corpus_spark.llm.batches import short_batches
from corpus_spark.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that no language's dictionary explains better than the others go; a missing lang is filled in.

    Null texts and texts without a letter go, copies are judged alike; columns may have any names; an empty table
    gives an empty one.
    """
    short_batches(spark)
    model = zstd_language.learn(docs)
    lang = F.coalesce(F.col("row")["lang"], "lang_pred").alias("lang")
    return (
        zstd_language.identify(docs.select(F.struct("*").alias("row"), "text"), model)
        .filter("NOT lang_rejected")
        .select(*[lang if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])
    )


NEAR_PERCENT, NEAR_MATCHES = 80, 14  # a pair at 0.80 agrees in fewer than 14 coordinates with a chance of 1.2e-6


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.80 or more) stays, the one with the smallest id.

    A document is an id and a text: rows that repeat both are one, and of an id with several texts each text is judged by
    itself. Rows without an id come behind all others. Texts without words stay; columns may have any names; an empty
    table gives an empty one.
    """
    short_batches(spark)
    name = F.xxhash64("doc_id", "text").alias("name")
    found = minhash_join.near_duplicates(docs.select(name, "text"), "name", percent=NEAR_PERCENT, matches=NEAR_MATCHES)
    groups = found.select("name", F.col("component_id").alias("group")).distinct()
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "name")).alias("first")
    ids = docs.select(name, F.col("doc_id").alias("id")).distinct()
    kept = ids.join(groups, "name").groupBy("group").agg(first).select("first.name")
    rows = docs.select(F.struct("*").alias("row"), name, F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    return rows.join(kept, "name", "left_semi").dropDuplicates(["name", "id", "digest"]).select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind; every row stays, null and empty texts as they are."""
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return secret_links.redact(docs).select(*[length if c == "n_chars" else F.col(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, twice at most; a null source is a source, an empty table gives an empty one."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, repeats by themselves; null and empty texts have none."""
    short_batches(spark)
    return piece_suffixes.encode(docs, piece_suffixes.Pieces.load())


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("sentencepiece", encode),
]

# Compression and near-duplicates are not SQL; tests/llm holds each stage against its effects.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
