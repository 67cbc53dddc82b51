"""The corpus pipeline: what quality, line, near-copy and packing operators make of ``documents``, in that order.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet and read again by the next. All but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm import line_dedup, packing, quality, simhash
from factlake.llm.common import discard, read_table, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at its threshold or above. A null text scores as an empty one; equal texts score alike."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.scored(docs.select(*COLUMNS), model, "_score").filter(F.col("_score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; n_chars follows the text.

    A document of nothing but such lines is one of many copies and stays whole: which of them stays is the next stage's decision, and that reads texts.
    A null text stays null, and its n_chars becomes null; a null source is a source of its own; repeated rows count as so many documents.
    """
    left = line_dedup.drop_boilerplate(docs.select(*COLUMNS), host="source", spare=True)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 of five-word shingles, found by SimHash): the one with the smallest doc_id.

    Rows with a null doc_id stay; of rows that repeat a doc_id one stays; null and empty texts are copies of each other.
    """
    return simhash.keep_one(docs.select(*COLUMNS), words=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of several sizes, one row a piece of a document. A null text has its end id alone; repeated rows are packed as often as they occur."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("line_dedup", drop_lines), ("near_dedup", drop_copies), ("packing", pack)]

#: A fitted model and fingerprints are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has written is deleted when the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
