"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm import bpe, digest, hash_forest, line_dedup, packing, quality, sharding, simhash, url_rules, warc
from factlake.llm.common import read_table, scratch

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, host="source", dropped="dropped_lines")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in batches of small shards, are compacted, and are read back by the last manifest.

    ``arrived`` is the version of the last arrival, ``compacted`` whether a later one has merged shards, ``settled`` whether no tier is full.
    """
    store = sharding.ShardStore(spark, scratch(spark, "shards"))
    arrived = store.append_dealt(read_table(spark, sf_dir, "documents"))
    last = store.compact()
    return store.read().select("*", F.lit(arrived).cast("long").alias("arrived"), F.lit(last > arrived).alias("compacted"), F.lit(store.settled()).alias("settled"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(read_table(spark, sf_dir, "documents"), words=4, radius=4)


def op9_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.with_next(read_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    found = quality.scored(docs, model)
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


CURATED = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents serve for the pages of the same id: of low quality or toxic is to be blocked."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    rules = url_rules.mine(pages.join(labels, "page_id").select("url", "block"))
    return url_rules.judge(pages, CURATED, rules).select("page_id", "host", "path", "rule", "verdict")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    known = warc.payloads(pages, "page_id", "html")
    path = scratch(spark, "warc")
    records = warc.convert(warc.arc_records(pages, "page_id", "url", "html"), warc.copies(known))
    warc.write(records, path, warc.file_records(known))
    found = warc.read(spark, path)
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.search(read_table(spark, sf_dir, "embeddings"), every=20)


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op3_sharding": op3_sharding,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_simhash": op5_simhash,
    "op6_url_rules": op6_url_rules,
    "op7_warc": op7_warc,
    "op8_hash_forest": op8_hash_forest,
    "op9_quartile_digest": op9_quartile_digest,
    "op10_quality": op10_quality,
}

SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op3_sharding": f"SELECT doc_id, text, lang, source, n_chars, CAST({sharding.ARRIVALS} AS BIGINT) AS arrived, true AS compacted, true AS settled FROM documents",
    "op7_warc": warc.SQL,
}
