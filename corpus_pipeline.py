"""A corpus pipeline: each stage takes all that the one before it kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which ``run`` writes as Parquet in the shared folder and reads again as the next
stage's docs. All stages but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nuqta.llm import bwt_dedup, kneser_ney, language_id, near_dup, packing
from nuqta.llm.common import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in no known language go, null and empty texts among them; ``lang``
    becomes the one found. Each row is judged by itself; an empty table gives an empty one;
    other columns stay, whatever their names."""
    return language_id.keep_identified(docs, language_id.train(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows less like trusted text than their language's threshold go, null and empty texts
    among them. Each row is judged by itself; an empty table gives an empty one; other columns
    stay, whatever their names."""
    return kneser_ney.keep_good(docs, kneser_ney.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least doc_id stays, as one row.
    Rows without a doc_id, a text or a word stay; an empty table gives an empty one; other
    columns stay, whatever their names."""
    return near_dup.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur at an earlier place are cut out; documents of
    which nothing else is left go. Rows without a doc_id or a text stay as they are; an empty
    table gives an empty one; other columns stay, whatever their names, but for n_chars."""
    return bwt_dedup.remove_passages(docs).where("text is null or trim(text) <> ''")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 2,048 words along the curve."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("quality", quality), ("near_dedup", near_duplicates), ("suffix_dedup", passages), ("packing", packed)]

#: No stage but the joins can be put in SQL; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
