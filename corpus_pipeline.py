"""Corpus pipeline: documents to clean, unique, decontaminated, mixed and sharded training rows."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loadshape.llm import decontaminate, language, mixing, sharding, simhash  # noqa: E402
from loadshape.llm.common import shared_path  # noqa: E402

#: Documents whose language is less certain than this go.
MIN_LANGUAGE_SCORE = 0.5
#: How often the most repeated source is read at most, while every source is read whole at least once.
MAX_REPETITION = 2.0
SHARDS = 24


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no certain language, go; NULL and empty texts have no letters.

    Without labelled documents no language is known and every document goes.
    """
    model = language.fit(docs, "lang", "text")
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    kept = language.predict(named, model, "text").where(
        (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    )
    return kept.select("row.*")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: fingerprints of three-word shingles, linked at three or fewer differing bits.

    NULL and empty texts are one group; of documents equal in id and text one stays.
    """
    return simhash.deduplicate(docs, "doc_id", "text", words_per_shingle=3, max_distance=3)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, repeated ones too; NULL and empty texts hold none."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "text", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources nearer to equal shares: rows of small ones are repeated, none is lost.

    A NULL source is a source; documents without words are read with the block they hash to.
    """
    # packed, so that columns named like mixing's own come through
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    identity = F.struct("document.doc_id", F.xxhash64("document.text"))
    packed = packed.withColumn("mixed_source", F.col("document.source"))
    mixed = mixing.mix(packed, "mixed_source", mixing.count_tokens(F.col("document.text")), identity, max_repetition=MAX_REPETITION)
    return mixed.select("document.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: shards of near equal size, equal texts side by side.

    NULL and empty texts are equal; columns named ``shard`` or ``slot`` are replaced.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    return sharding.assign_shards(docs, size, F.coalesce("text", F.lit("")), F.col("doc_id"), shards=SHARDS)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Naive Bayes, fingerprints and edit distances have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
