"""A training-data pipeline over documents: toxicity, exact dedup, near dedup, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.content_sort import content_sort, normalised
from larder.llm.minhash import near_duplicates
from larder.llm.packing import pack
from larder.llm.pii import sanitise
from larder.llm.toxicity import toxic_score, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Null and empty texts stay; a null id is judged by its text."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select(COLUMNS).where(toxic_score(F.col("text"), model) < 0.5)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside; of rows that repeat an id and a text, one. Null texts are empty."""
    kept = content_sort(docs).where("kept").select(F.col("doc_id").alias("id"), "text_sha256").distinct()
    keyed = docs.select(COLUMNS).withColumn("sha", F.sha2(normalised(), 256))
    one = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["id"]) & (keyed["sha"] == kept["text_sha256"]))
    best = F.max(F.struct(F.char_length(F.coalesce("text", F.lit(""))).alias("length"), *COLUMNS)).alias("row")
    return one.groupBy("id", "sha").agg(best).select([F.col(f"row.{c}").alias(c) for c in COLUMNS])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, a similarity of 0.8 or more.

    Documents without words, or without an id, are near nothing and stay. What goes is told by id and text, so other
    texts under a repeated id stay; of rows that repeat an id and a text one stays.
    """
    gone = near_duplicates(docs, shingle_words=5, percent=80).where("not leads").select("doc_id", F.col("text_hash").alias("hash")).distinct()
    nameless = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    keyed = docs.select(COLUMNS).withColumns({"hash": F.xxhash64(F.coalesce("text", F.lit(""))), "row": nameless})
    return keyed.join(gone, ["doc_id", "hash"], "left_anti").dropDuplicates(["doc_id", "hash", "row"]).select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data and terms that give it away replaced in its text. Null texts stay null."""
    return sanitise(docs.select(COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of at most 1024 tokens. A null text is its end id alone."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=1024, end_id=0)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing)]

#: Classifier, MinHash and tokenizer can't be told in SQL; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
