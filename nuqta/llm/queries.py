"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bwt_dedup, hash_tree, iso_media, kneser_ney, language_id, near_dup, packing, rp_forest, sentence_spans

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    codec = bpe.fit(docs)
    return bpe.decode(bpe.encode(docs, codec), codec)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has media: each document's whole text is put in a container, whose tracks
    are then read."""
    return iso_media.tracks(iso_media.media_of(table(spark, sf_dir, "documents")))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.assign(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return kneser_ney.assess(docs, kneser_ney.train(docs, table(spark, sf_dir, "labels")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op9_repeated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.repeated_sentences(table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours, among all vectors, of those whose id is divisible by 20."""
    return rp_forest.neighbours(table(spark, sf_dir, "embeddings"), ask=F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_hash_tree": hash_tree.assign_sql(),
        "op9_repeated_sentences": sentence_spans.repeated_sentences_sql(),
    }
