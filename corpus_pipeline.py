"""Corpus preparation: language ID, line dedup, near-dedup and packing, each over what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import langid, linededup, neardup, packing
from lexispark.llm.common import forget, written

_ID, _KEY = "__doc_id", "__text_key"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that language ID rejects: blank texts, and texts of no known language."""
    judged = langid.identify(docs, langid.fit(docs), host_col="source", keep_text_key=True)
    # verdicts first: the filter would be pushed into the judgement and repeat it
    verdicts = written(judged.select(F.col("doc_id").alias(_ID), F.col("text_key").alias(_KEY), "rejected"), "verdicts")
    # then the short list, so that Spark knows its size and needn't shuffle all texts to meet it
    gone = written(verdicts.filter("rejected").select(_ID, _KEY).distinct(), "rejected")
    forget(verdicts)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(_ID)) & (F.xxhash64("text") == F.col(_KEY)), "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; ``n_chars`` follows the text. A text of nothing but repeated lines is dropped."""
    out = linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return out.filter((F.col("removed_lines") == 0) | F.col("text").rlike(r"\S")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id."""
    gone = written(neardup.near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias(_ID)).distinct(), "duplicates")
    return docs.join(gone, F.col("doc_id") == F.col(_ID), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", pack)]

#: The stages aren't expressible in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
